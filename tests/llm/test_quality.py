import zlib

import numpy as np

from gigmatch.llm import quality
from gigmatch.llm.features import NAMES, line_features


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    good = (label == 1).sum()
    return (rank[label == 1].sum() - good * (good + 1) / 2) / (good * (len(label) - good))


def test_held_out_quality(spark, sf1):
    got = quality.op1_crf_quality(spark, sf1).toPandas()
    docs = spark.read.parquet(f"{sf1}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((got.predicted == 1) == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    known = spark.read.parquet(f"{sf1}/labels.parquet").toPandas().merge(got[got.held_out], on="doc_id")
    assert auc(known.score.to_numpy(), known.quality.to_numpy()) > 0.95
    assert ((known.score >= 0.3) == (known.quality == 1)).mean() > 0.95


def test_odd_rows(odd, none, labels):
    got = quality.classify(odd, labels).toPandas()
    assert len(got) == odd.count() and got.score.notna().all()
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).count() == odd.count()


def test_documents_of_many_lines_are_learned_from(spark, monkeypatch):
    line = {1: "Plain prose about a thing that was said here, in whole sentences.", 0: "BUY!!! NOW $$$ | | | 777 #### CLICK"}
    rows = [(i, "\n".join([line[i % 2]] * 4000)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for lines, taken in ((300_000, None), (20_000, 6)):
        monkeypatch.setattr(quality, "TRAIN_LINES", lines)
        found = quality.sample(docs, labels, train_lines=lines).groupBy("quality").count().collect()
        assert len(found) == 2 and (taken is None or sum(r["count"] for r in found) == taken)
    got = {r.doc_id: r.predicted for r in quality.score(docs, quality.train(docs, labels, train_lines=20_000)).collect()}
    assert got == {i: i % 2 for i in range(40)}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    model = quality.Chain(rng.normal(size=5), stay=0.7)
    lines = np.array([4, 1, 3])
    x = rng.normal(size=(8, 5))
    good, same = model.marginals(x, lines)
    at = 0
    for n in lines:
        odds = x[at : at + n] @ model.weights
        states = np.array([[s >> i & 1 for i in range(n)] for s in range(1 << n)])
        weight = np.exp((states * odds).sum(1) + 0.7 * (states[:, 1:] == states[:, :-1]).sum(1))
        weight /= weight.sum()
        assert np.allclose(good[at : at + n], weight @ states)
        assert np.allclose(same[at + 1 : at + n], weight @ (states[:, 1:] == states[:, :-1]))
        at += n


def test_line_features():
    texts = ["", "one one two\n\nLOUD!! | 12", "same line\nsame line", "ä"]
    table, length, lines = line_features(texts)
    at = {n: i for i, n in enumerate(NAMES)}
    assert lines.tolist() == [1, 3, 2, 1]
    assert table[1, at["same_as_last_word"]] == 1 / 3
    assert table[3, at["upper"]] == 4 / 11 and table[3, at["bang"]] == 2 / 11 and table[3, at["digit"]] == 2 / 11
    assert table[4:6, at["repeated_line"]].tolist() == [1, 1] and table[1:4, at["repeated_line"]].sum() == 0
