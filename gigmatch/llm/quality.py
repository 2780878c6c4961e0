"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Its potentials see the features of the line and of the lines beside it, and a transition
potential ties neighbouring labels.  Forward-backward marginals, weighted by line length, give the share of a
document that is good; a logistic curve turns that share into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gigmatch.llm.common import documents, id_remainder, materialise, slices
from gigmatch.llm.features import NAMES, line_features
from gigmatch.llm.workers import lean

#: Expected number of labelled training documents, and of their lines in all (each takes some 500 bytes in the fit):
#: with longer documents fewer are taken, whatever the length of each.
TRAIN_DOCS, TRAIN_LINES = 5000, 300_000
THRESHOLD = 0.3
STEPS, ROUNDS, RATE, PENALTY = 150, 3, 0.1, 1e-4


def with_neighbours(table: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Features of each line, of the one before and of the one after in its document (0 at its ends), and a constant."""
    first = np.cumsum(lines) - lines
    before = np.roll(table, 1, axis=0)
    before[first] = 0
    after = np.roll(table, -1, axis=0)
    after[first + lines - 1] = 0
    return np.concatenate([table, before, after, np.ones((len(table), 1))], 1)


@dataclass
class Chain:
    """``weights`` give the log odds of good against bad for a line; ``stay`` is what two equal labels in a row add."""

    weights: np.ndarray
    stay: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    scale: float | np.ndarray = 1.0

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line, and P(same label as the line before); documents advance in step, longest first."""
        odds = np.clip(x @ self.weights, -30, 30)
        first = np.cumsum(lines) - lines
        order = np.argsort(-lines, kind="stable")
        first, counts = first[order], lines[order]
        still = np.searchsorted(-counts, -np.arange(counts[0] if len(counts) else 0), "left")  # documents with a line t
        node = np.stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))], 1)
        keep, switch = 1 / (1 + np.exp(-self.stay)), 1 / (1 + np.exp(self.stay))
        move = np.array([[keep, switch], [switch, keep]])
        forward, backward = np.ones((len(x), 2)), np.ones((len(x), 2))
        for t, n in enumerate(still):
            at = first[:n] + t
            a = node[at] if t == 0 else (forward[at - 1] @ move) * node[at]
            forward[at] = a / a.sum(1, keepdims=True)
        for t in range(len(still) - 2, -1, -1):
            at = first[: still[t + 1]] + t
            b = (backward[at + 1] * node[at + 1]) @ move
            backward[at] = b / b.sum(1, keepdims=True)
        both = forward * backward
        same = np.full(len(x), np.nan)
        inner = np.ones(len(x), bool)
        inner[np.cumsum(lines) - lines] = False
        at = np.flatnonzero(inner)
        if len(at):
            right = backward[at] * node[at]
            joint = forward[at - 1][:, :, None] * move * right[:, None, :]
            same[at] = (joint[:, 0, 0] + joint[:, 1, 1]) / joint.sum((1, 2))
        return both[:, 1] / both.sum(1), same

    def share(self, table: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document, as log odds."""
        good, _ = self.marginals(with_neighbours(table / self.scale, lines), lines)
        first = np.cumsum(lines) - lines
        part = np.add.reduceat(good * length, first) / np.add.reduceat(length, first)
        part = np.clip(part, 1e-3, 1 - 1e-3)
        return np.log(part / (1 - part))

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.share(*line_features(texts)) + self.offset)))


def fit(table: np.ndarray, length: np.ndarray, lines: np.ndarray, labels: np.ndarray) -> Chain:
    """Maximise the conditional likelihood of line labels.

    Lines begin with their document's label.  After each round, the lines of bad documents that the model takes for
    good get that label, but for the worst line of each: a bad document has a bad line.
    """
    scale = np.maximum(table.std(0), 1e-3)
    x, owner = with_neighbours(table / scale, lines), np.repeat(np.arange(len(lines)), lines)
    first = np.cumsum(lines) - lines
    y = labels[owner].astype(float)
    inner = np.ones(len(x), bool)
    inner[first] = False
    model = Chain(np.zeros(x.shape[1]), scale=scale)
    docs = max(1, len(lines))
    weight = 1 / np.repeat(lines, lines)  # documents count alike, whatever their length
    for _ in range(ROUNDS):
        m1, m2 = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
        same = np.where(inner, (y == np.roll(y, 1)), 0.0)
        for step in range(1, STEPS + 1):
            good, alike = model.marginals(x, lines)
            g = np.append(x.T @ ((y - good) * weight), (np.where(inner, same - np.nan_to_num(alike), 0) * weight).sum()) / docs
            g -= PENALTY * np.append(model.weights, model.stay)
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            delta = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            model.weights = model.weights + delta[:-1]
            model.stay = float(np.clip(model.stay + delta[-1], -4, 4))
        own = np.clip(x @ model.weights, -30, 30)
        worst = np.minimum.reduceat(own, first)[owner] if len(own) else own
        y = np.where(labels[owner] == 1, 1.0, ((own > 0) & (own > worst)).astype(float))
    z = model.share(table, length, lines)
    a, b = 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a + 0.2 * (((labels - p) * z).mean() - 1e-3 * a), b + 0.2 * (labels - p).mean()
    model.slope, model.offset = float(a), float(b)
    return model


def sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> DataFrame:
    """(text, quality) of about ``train_docs`` labelled rows whose id's remainder by 5 isn't 0, by a hash of the id.

    In that order documents of each label are taken until they hold half of ``train_lines``: the first that reaches
    it is the last one taken.
    """
    usable = labels.filter((id_remainder(F.col("doc_id"), 5) != 0) & F.col("quality").isNotNull())
    total = usable.count()
    share = min(1.0, train_docs / max(total, 1))
    mixed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = usable.filter(mixed < share * (1 << 30))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"))  # about train_docs rows
    known = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
    known = materialise(known, "quality-sample")
    body = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("quality").orderBy("mixed", "digest", "lines").rowsBetween(Window.unboundedPreceding, -1)
    lines = (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long")
    sizes = known.select("doc_id", "quality", mixed.alias("mixed"), F.xxhash64("text").alias("digest"), lines.alias("lines"))
    taken = sizes.withColumn("before", F.coalesce(F.sum("lines").over(order), F.lit(0))).filter(F.col("before") < train_lines / 2)
    taken = taken.select("doc_id", "quality", "digest").distinct()
    one = known.withColumn("digest", F.xxhash64("text")).join(F.broadcast(taken), ["doc_id", "quality", "digest"], "left_semi")
    return one.select("text", "quality")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Chain:
    """Fit on the ``sample``; texts stay in the cluster, the driver gets features of about ``train_lines`` lines."""
    found = sample(docs, labels, train_docs, train_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column("text").to_pylist(), batch.column("quality").to_pylist()
            for start, end in slices([len(t or "") for t in texts], 2_000_000):
                table, length, lines = line_features([t or "" for t in texts[start:end]])
                ends = np.cumsum(lines)
                for i, n in enumerate(lines):
                    part = np.concatenate([table, length[:, None]], 1)[ends[i] - n : ends[i]]
                    row = [pa.array([part.astype(np.float32).tobytes()]), pa.array([marks[start + i]], pa.int32())]
                    yield pa.RecordBatch.from_arrays(row, ["lines", "quality"])

    rows = found.mapInArrow(lean(run), "lines binary, quality int").collect()
    rows.sort(key=lambda r: (r["quality"], bytes(r["lines"])))  # the fit doesn't depend on the order of tasks
    parts = [np.frombuffer(r["lines"], np.float32).reshape(-1, len(NAMES) + 1).astype(float) for r in rows]
    marks = np.array([r["quality"] for r in rows])
    if len(set(marks.tolist())) < 2:
        always = 3.0 if not len(marks) or marks[0] == 1 else -3.0
        return Chain(np.zeros(3 * len(NAMES) + 1), slope=0.0, offset=always)
    whole = np.concatenate(parts)
    return fit(whole[:, :-1], whole[:, -1], np.array([len(p) for p in parts]), marks)


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; null text counts as empty, one empty line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = np.zeros(len(texts))
            for start, end in slices([len(t) for t in texts], 1_000_000):
                found[start:end] = model.score(texts[start:end])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from ``labels`` (doc_id, quality) and score every row of ``docs`` (doc_id, text).

    One row per row of ``docs``, repeated rows and null ids (not held out) included; the same text gets the same
    score.  Null and empty texts are scored as one empty line; whole texts count, however long.  Labels without a
    quality or a document are left out; of several for one id the highest counts.  Without labels of both kinds the
    score is one constant: high, unless all are 0.  An empty table gives an empty result; further columns, whatever
    their names, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(rows, train(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")))


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
