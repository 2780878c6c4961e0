import hashlib
from collections import Counter

import numpy as np
import pytest

from gigmatch.llm import alignment

SPACE = "▁"


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(alignment.public_path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=alignment.public_path("piece_bpe_32k.model"))


def brute(texts, first, second):
    """Rows without ids, by whole encodings and comparing all token pairs of a document around each other's ranges."""
    from gigmatch.llm.token_counts import byte_of

    table = byte_of()
    docs = []
    for text in texts:
        ids_a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = second.encode(text, num_threads=1) if text else []
        a = [bytes(table[c] for c in first.id_to_token(i)) for i in ids_a]
        shown = [second.id_to_piece(i) for i in ids_b]
        b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in zip(ids_b, shown)]
        if not text or b"".join(a) != (" " + text).encode() or b"".join(b) != (" " + text).encode():
            docs.append(([], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
        links, groups, i, j, last = [], [], 0, 0, (0, 0)
        while i < len(a) and j < len(b):
            links.append((ids_a[i], ids_b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, ids_a[last[0] : i])) + "|" + ",".join(map(str, ids_b[last[1] : j])))
                last = (i, j)
        docs.append((ids_a, ids_b, links, groups))
    counts = Counter(link for d in docs for link in d[2])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (len(d[0]), len(d[1]), len(d[3]) if d[0] else 0, len(d[2]), sum(counts[x] == most[x[1]] for x in d[2]), sum(counts[x] for x in d[2]),
         hashlib.sha256(";".join(d[3]).encode()).hexdigest() if d[0] else "")
        for d in docs
    ]


def rows_of(df):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return [(r.doc_id, tuple(r[c] for c in names)) for r in df.collect()]


ODD = [
    "plain words here", " leading and trailing ", "two  spaces   three", "tab\tand\nline \n\n ends", "<|endoftext|> <s> </s> are text", "Größe ½ 東京 مرحبا 👩‍👩‍👧",
    f"a mark {SPACE} of space", "nbsp  here 　 wide", "don't we've I'll", "x" * 5000, "null\x00byte", "", None, "a", " ", "é combining \u0085 next", "﻿ bom ​ zero",
]


@pytest.mark.parametrize("hot", [0, 5, 1 << 18])
def test_odd_texts_by_brute_force(spark, tokenizers, hot):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = sorted(rows_of(alignment.align_tokenizers(df, hot=hot)))
    assert [r for _, r in got] == brute([t or "" for t in ODD], *tokenizers)


def test_links_are_all_overlaps(tokenizers):
    coder = alignment.Coder(alignment.public_path("byte_bpe_50k.json"), alignment.public_path("piece_bpe_32k.model"))
    text = "Unforgettable größere overlappings, unaligned."
    found = alignment.align(coder, *coder.encode([text, text])).to_pydict()
    ids_a, ids_b = (x.to_pylist()[0] for x in coder.encode([text]))
    ends_a, ends_b = np.cumsum([len(coder.bytes_a[i]) for i in ids_a]), np.cumsum([len(coder.bytes_b[i]) for i in ids_b])
    starts_a, starts_b = ends_a - [len(coder.bytes_a[i]) for i in ids_a], ends_b - [len(coder.bytes_b[i]) for i in ids_b]
    expected = Counter((a << coder.shift) | b for a, s, e in zip(ids_a, starts_a, ends_a) for b, t, f in zip(ids_b, starts_b, ends_b) if s < f and t < e)
    assert all(Counter(dict(zip(p, n))) == expected for p, n in zip(found["pairs"], found["times"]))
    assert found["n_links"] == [expected.total()] * 2


def test_remembered_ids_start_anew(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 3)
    coder = alignment.Coder(alignment.public_path("byte_bpe_50k.json"), alignment.public_path("piece_bpe_32k.model"))
    for text in ODD[:6] * 2:
        a, b = coder.encode([text])
        assert a.to_pylist()[0] == tokenizers[0].encode(" " + text, add_special_tokens=False).ids
        assert b.to_pylist()[0] == tokenizers[1].encode(text)


def test_white_space_at_the_ends_of_neighbouring_texts(spark, tokenizers):
    ends = ["", " ", "  ", "\n", " \n", "\t ", "\u00a0 ", "\x1c"]
    texts = [f"{before}word{i}{after}" for i, (before, after) in enumerate((b, a) for b in ends for a in ends)]
    coder = alignment.Coder(alignment.public_path("byte_bpe_50k.json"), alignment.public_path("piece_bpe_32k.model"))
    a, b = coder.encode(texts)  # learnt together
    assert a.to_pylist() == [tokenizers[0].encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert b.to_pylist() == [tokenizers[1].encode(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r for _, r in sorted(rows_of(alignment.align_tokenizers(df)))] == brute(texts, *tokenizers)


def test_odd_rows(spark, odd, none, tokenizers):
    got = rows_of(alignment.align_tokenizers(odd))
    rows = odd.collect()
    expected = brute([r.text or "" for r in rows], *tokenizers)
    assert sorted(got, key=str) == sorted(((r.doc_id, e) for r, e in zip(rows, expected)), key=str)
    assert alignment.align_tokenizers(none).count() == 0


def test_query(spark, sf1, tokenizers):
    docs = sorted(spark.read.parquet(f"{sf1}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = sorted(rows_of(alignment.op11_tokenizer_alignment(spark, sf1)))
    assert [i for i, _ in got] == [d.doc_id for d in docs]
    assert [r for _, r in got] == brute([d.text or "" for d in docs], *tokenizers)
