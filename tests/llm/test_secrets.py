import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gigmatch.llm import secrets
from gigmatch.llm.common import has_bit

BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = []
    for k, (kind, (regex, good)) in enumerate(BASE.items()):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(regex, text or "", re.ASCII) if good(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


def check(rows):
    for doc_id, text, got in rows:
        want = brute(text)
        assert got.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (doc_id, want, got.spans)
        assert [getattr(got, f"n_{k}") for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert [s for s in got.spans.split(",") if s.split(":")[0] in BASE] == want


def run(spark, texts, tmp_path):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in secrets.op9_trigram_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    check([(i, t, got[i]) for i, t in enumerate(texts)])
    return got


def test_odd_texts(spark, tmp_path):
    key = "AKIA" + "Z" * 16
    texts = [
        None, "", "password=abcdef", "PassWord\"  :  'abcdefg", "passwd:abc token=secret=longvalue", "api_key=x api-key=abcdefg apikey: 1234567",
        key, key[:-1], "AKIA" + "AKIA" * 5, "xAKIA" + "9" * 40 + "a", "0123456789abcdef01234567", "0123456789abcdef0123456", "ABCDEF" * 9 + "abcdef" * 4,
        "ünï 東京 token = " + "q" * 9 + " 😀 secret:\n", "ſecret=abcdefg toKen=abcdefg", "secret" * 50, "x" * 300_000 + " token:abcdef", "a" * 100_000,
        "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIi.abc ghp_" + "a1" * 20, key + " " + key + "," + "f" * 24 + " password:" + "f" * 30,
    ]
    got = run(spark, texts, tmp_path)
    assert got[18].spans.startswith("pem:0:") and "webtoken:" in got[19].spans and "repotoken:" in got[19].spans


def test_repeated_and_null_ids(odd, none):
    rows = secrets.scan(odd).collect()
    assert len(rows) == odd.count() and len([r for r in rows if r.found]) == 1
    assert secrets.scan(none).count() == 0


def test_documents_against_sql(spark, sf1):
    got = {r.doc_id: r for r in secrets.op9_trigram_secret_scan(spark, sf1).collect()}
    docs = spark.read.parquet(f"{sf1}/documents.parquet").collect()
    check([(d.doc_id, d.text, got[d.doc_id]) for d in docs])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf1}/documents.parquet'")
    assert sum(r[1] for r in con.execute(f"SELECT doc_id, n_assign FROM ({secrets.SQL})").fetchall()) == sum(r.n_assign for r in got.values())


@settings(max_examples=200, deadline=None)
@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
@given(st.data())
def test_every_match_satisfies_the_query(rule, data):
    match = data.draw(st.from_regex(rule.regex, fullmatch=True)).lower()
    held = {match[i : i + 3] for i in range(len(match) - 2)}
    for condition in secrets.trigram_query(rule.regex):
        assert any(option <= held for option in condition)


def test_queries():
    by = {r.kind: secrets.trigram_query(r.regex) for r in secrets.RULES}
    assert by["hex"] == [] and by["access"] == [[frozenset({"aki", "kia"})]]
    assert frozenset({"tok", "oke", "ken"}) in by["assign"][0] and len(by["assign"][0]) == 6


def test_postings_are_intersected(spark):
    """Candidates are exactly the rows whose trigrams satisfy a rule's query."""
    texts = ["password=abcdef", "AKIA", "kia aki", "aki", "secret token", "eyjx.eyj", "-----begin x private key-----", "nothing", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    trigrams = secrets.vocabulary(secrets.RULES)
    near = secrets.candidates(secrets.trigram_index(rows, trigrams), secrets.RULES, trigrams)
    got = rows.join(near, F.bitmap_bucket_number(F.col("_row") + 1) == F.col("_bucket"), "left")
    got = got.select("_row", *[has_bit(F.col(f"_rule_{i}"), F.col("_row")).alias(f"r{i}") for i in range(len(secrets.RULES))]).collect()
    for r in got:
        low = (texts[r._row] or "").lower()
        held = {low[i : i + 3] for i in range(len(low) - 2)}
        for i, rule in enumerate(secrets.RULES):
            query = secrets.trigram_query(rule.regex)
            assert r[f"r{i}"] == (bool(query) and all(any(o <= held for o in c) for c in query)), (low, rule.kind)


def test_rules_without_trigrams_scan_fully(spark):
    rows = secrets.scan(spark.createDataFrame([(1, "f" * 30)], "doc_id long, text string"), (secrets.BASE[2],)).collect()
    assert [(s.start, s.end) for s in rows[0].found] == [(0, 30)]
