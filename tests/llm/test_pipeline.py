import re
from statistics import mean

import corpus_pipeline
import pytest

from gigmatch.llm import language, mixing, simhash
from gigmatch.llm.common import materialise


@pytest.fixture(scope="module")
def steps(spark, sf1):
    docs = spark.read.parquet(f"{sf1}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf1), name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    for before, after in zip(steps, steps[1:-1]):
        assert set(ids(after)) <= set(ids(before))


def test_language_stage(steps):
    found = {r.doc_id: r for r in language.identify(steps[0]).collect()}
    want = [i for i in ids(steps[0]) if found[i].lang_pred != "und" and found[i].score >= corpus_pipeline.LEAST_SCORE]
    assert ids(steps[1]) == want and len(want) >= 0.99 * steps[0].count()


def test_exact_stage(steps):
    first = {}
    for r in sorted(steps[1].collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert ids(steps[2]) == sorted(first.values())


def test_near_stage(steps):
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(steps[2]).collect()}
    assert ids(steps[3]) == sorted(set(component.values()))


def test_mixing_keeps_clean_documents(spark, sf1, steps):
    table = spark.read.parquet(f"{sf1}/labels.parquet")
    labels = {r.doc_id: (r.quality, r.toxic) for r in table.collect()}
    rates = {r.doc_id: min(r.rate, 1.0) for r in mixing.mix(steps[3], table).collect()}
    expected = lambda keep: mean(rates[i] for i in rates if labels.get(i) in keep)
    assert expected({(1, 0)}) > 0.95 and expected({(1, 1), (0, 1)}) < 0.4 * expected({(1, 0)})
    before, after = set(ids(steps[3])), set(ids(steps[4]))
    assert {i for i in before if rates[i] == 1.0} <= after and not any(rates[i] == 0 for i in after)
    assert abs(len(after) - sum(rates.values())) < 4 * len(before) ** 0.5


def test_packing_covers_what_is_left(steps):
    assert sorted({r.doc_id for r in steps[5].collect()}) == ids(steps[4])


def test_stages_on_an_empty_table(spark, sf1):
    docs = spark.read.parquet(f"{sf1}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf1), "empty")
        assert docs.count() == 0


def test_whole_run_on_odd_rows(spark, sf1, odd, tmp_path):
    """Odd rows among plain ones, with columns whose names the library uses inside; no column changes on the way."""
    plain = spark.read.parquet(f"{sf1}/documents.parquet")
    odd = odd.selectExpr("*", "5 AS `a.b`")
    both = odd.unionByName(plain.withColumn("doc_id", plain["doc_id"] + 1000), allowMissingColumns=True)
    both.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf1}/labels.parquet").selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        if name != "packing":
            assert after.columns == both.columns
            assert after.exceptAll(docs).isEmpty()
        docs, before = after, docs
    kept = {r.doc_id for r in before.select("doc_id").collect()}
    assert not kept & {3, 4, 5} and {1, 9} & kept and not {2, 8} & kept
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
