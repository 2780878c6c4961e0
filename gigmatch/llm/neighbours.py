"""Approximate nearest neighbours with learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts; a small classifier learns to tell a vector's
part.  Every vector is stored under its most probable part, a query goes to its several most probable ones, and all
vectors found there are ranked by their exact distance.  A query visits parts until their probabilities add up to a
total, so a clear one visits fewer; the total is set on vectors left out of the fit, by the recall that they reach
against all of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gigmatch.llm.common import materialise

NEAREST, QUERY_EVERY = 10, 100
#: Sample for the graph and the classifier, its neighbours per vector, and stored vectors wanted per part.
SAMPLE, GRAPH, PART_ROWS = 6000, 10, 400
HIDDEN, EPOCHS, BATCH, RATE = 128, 40, 256, 0.003
#: Recall wanted on vectors of the sample that the router wasn't fitted on (a tenth, at most ``ASKED``).
WANTED, ASKED = 0.97, 600
#: Divisors of the router's outputs that are tried.
HEATS = (1.0, 2.0, 4.0, 8.0)
#: Stored vectors and queries that are compared in one group.
BLOCK = 1024


def _nearest(x: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Rows of the k nearest of ``x`` for each query, in blocks; ``own``: the query's own row, left out."""
    out = np.zeros((len(queries), k), np.int64)
    norms = (x * x).sum(1)
    for s in range(0, len(queries), 512):
        d = norms[None, :] - 2 * queries[s : s + 512] @ x.T
        if own is not None:
            d[np.arange(len(d)), own[s : s + 512]] = np.inf
        out[s : s + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """A part per vector, sizes at most a twentieth above the mean: grown from spread centres, then refined on the graph.

    In each round vectors move, those that gain most first, to the part that holds most of their neighbours (both
    ways), as long as it has room.
    """
    rng, n = np.random.default_rng(seed), len(x)
    room = int(np.ceil(n / parts * 1.05))
    centres = x[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int64)
    for _ in range(6):
        d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
        ranked = np.argsort(d, axis=1)
        sizes, label = np.zeros(parts, np.int64), np.full(n, -1)
        for i in np.argsort(d.min(1) - np.partition(d, min(1, parts - 1), axis=1)[:, min(1, parts - 1)]):
            for p in ranked[i]:
                if sizes[p] < room:
                    label[i], sizes[p] = p, sizes[p] + 1
                    break
        centres = np.stack([x[label == p].mean(0) if (label == p).any() else centres[p] for p in range(parts)])
    rows = np.repeat(np.arange(n), neighbours.shape[1])
    a, b = np.concatenate([rows, neighbours.ravel()]), np.concatenate([neighbours.ravel(), rows])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (a, label[b]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A one-hidden-layer classifier over parts, and the probability that the parts a query visits add up to.

    ``heat`` divides the classifier's outputs, so that probabilities are spread as vectors it wasn't fitted on need it.
    """

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0
    heat: float = 1.0

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row all parts, most probable first, and the probability of the parts before each."""
        out = (np.maximum(0, (x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2) / self.heat
        order = np.argsort(-out, axis=1, kind="stable").astype(np.int32)
        p = np.exp(np.take_along_axis(out, order, 1) - out.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return order, np.concatenate([np.zeros((len(p), 1)), np.cumsum(p, 1)[:, :-1]], axis=1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each row, where it is stored."""
        return self.ranked(x)[0][:, 0]

    def visited(self, x: np.ndarray, held: np.ndarray, least: int) -> list[np.ndarray]:
        """Per row its most probable parts, until they add up to ``mass`` and hold ``least`` of the ``held`` ids by part."""
        order, before = self.ranked(x)
        there = held[order]
        wanted = (before < self.mass) | (np.cumsum(there, 1) - there < least)
        return [parts[: max(many, 1)] for parts, many in zip(order, wanted.sum(1))]


def tune(router: Router, x: np.ndarray, asked: np.ndarray, near: np.ndarray) -> None:
    """Sets ``mass`` and ``heat``: the fewest visits by which the rows ``asked`` of ``x`` find ``WANTED`` of their ``near``."""
    best, home = None, router.home(x)
    for heat in HEATS:
        router.heat = heat
        order, before = router.ranked(x[asked])
        place = np.argsort(order, axis=1)  # of each part in a row's order
        needed = np.sort(np.take_along_axis(before, np.take_along_axis(place, home[near], 1), 1), axis=None)
        mass = float(np.nextafter(needed[int(np.ceil(WANTED * len(needed))) - 1], 2.0))
        visits = (before < mass).sum()
        if best is None or visits < best[0]:
            best = visits, mass, heat
    _, router.mass, router.heat = best


def fit(sample: np.ndarray, parts: int, seed: int = 5) -> Router:
    """A router fitted on ``sample`` but for a tenth of it (at most ``ASKED``), by which its visits are tuned."""
    rng = np.random.default_rng(seed)
    mixed = rng.permutation(len(sample))
    asked, x = mixed[: min(len(sample) // 10, ASKED)], sample
    if parts > 1:
        x = sample[np.sort(mixed[len(asked) :])]
    n, dim = x.shape
    router = Router(
        x.mean(0), np.maximum(x.std(0), 1e-9), rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts),
    )
    if parts == 1:
        return router
    k = min(GRAPH, n - 1)
    near = _nearest(x, x, k, np.arange(n))
    label = balanced_parts(x, near, parts)
    # The target is the spread of a vector's neighbours (and itself) over the parts, not its own part alone.
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), k), label[near].ravel()), 1.0)
    target[np.arange(n), label] += 1.0
    target /= target.sum(1, keepdims=True)
    z = (x - router.mean) / router.spread
    names, state, t = ("w1", "b1", "w2", "b2"), {}, 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            t += 1
            h = np.maximum(0, z[rows] @ router.w1 + router.b1)
            out = h @ router.w2 + router.b2
            p = np.exp(out - out.max(1, keepdims=True))
            err = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (err @ router.w2.T) * (h > 0)
            for name, g in zip(names, (z[rows].T @ back, back.sum(0), h.T @ err, err.sum(0))):
                m, v = state.get(name, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                state[name] = (m, v)
                setattr(router, name, getattr(router, name) - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
    tune(router, sample, asked, _nearest(sample, sample[asked], k, asked))
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double): not null, not all zero, all components there and finite, of the usual length.

    Vectors of another length than the most frequent (of several, the smallest) have no distance to it and take no part.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists("v", lambda c: c != 0)
    )
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual["n"] if usual else 0))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = QUERY_EVERY, k: int = NEAREST, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found (Euclidean) of the rows whose id ``every`` divides.

    Equal vectors are stored once with their k + 1 smallest ids: no more of them can be in any answer, as ties go to
    smaller ids.  Rows repeated whole count once.  A query whose parts hold fewer than k candidates goes on to its next
    most probable ones until they do, or to all.  An empty table gives an empty result.
    """
    rows = materialise(usable(vectors), "vectors").distinct()
    total = rows.count()
    schema = "query_id long, vec_id long, score double"
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    copies = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1)
    stored = materialise(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors-stored")
    n = stored.count()
    chosen = stored.select("v").filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30))
    taken = chosen.toPandas()["v"]
    x = np.stack([np.array(v) for v in taken]) if len(taken) > 1 else np.array(stored.limit(2).toPandas()["v"].tolist())
    x = x[np.lexsort(x.T[::-1])]
    router = fit(x, max(1, min(n // part_rows, len(x) // 50)))

    def routed(name: str, route):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
                if not batch.num_rows:
                    continue
                found = pa.array(route(flat.reshape(batch.num_rows, -1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

        return run

    index = stored.mapInArrow(routed("part", router.home), "v array<double>, ids array<long>, part int")
    index = materialise(index, "vectors-index")
    held = np.zeros(len(router.b2), np.int64)
    for r in index.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect():  # one row per part
        held[r["part"]] = r["n"]
    asked = rows.filter(F.col("vec_id") % every == 0)
    queries = asked.mapInArrow(routed("parts", lambda x: router.visited(x, held, k + 1)), "vec_id long, v array<double>, parts array<int>")
    queries = materialise(queries.select("vec_id", "v", F.explode("parts").alias("part")), "vectors-queries")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))

    sizes = blocks(index, "i_blocks").join(blocks(queries, "q_blocks"), "part")  # one row per part
    spread = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = index.join(F.broadcast(sizes), "part").select(
        "part", F.pmod(F.xxhash64("v"), F.col("i_blocks")).cast("int").alias("i"), spread("q_blocks").alias("q"), "v", "ids"
    )
    right = queries.join(F.broadcast(sizes), "part").select(
        "part", spread("i_blocks").alias("i"), F.pmod(F.xxhash64("vec_id"), F.col("q_blocks")).cast("int").alias("q"), "vec_id", "v"
    )

    def compare(there: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(there) and len(asked):
            # Rough squares of distances by one product tell which few get exact ones; the slack is far above their error.
            y, q, ids = np.stack(there["v"]), np.stack(asked["v"]), there["ids"].tolist()
            norms, last = (y * y).sum(1), min(k, len(y) - 1)
            rough = norms - 2 * q @ y.T
            slack = 1e-9 * (norms.max() + (q * q).sum(1))
            for query, v, r, more in zip(asked["vec_id"], q, rough, slack):
                sure = np.isfinite(r).all() and np.isfinite(more)
                near = np.flatnonzero(r <= np.partition(r, last)[last] + more) if sure else np.arange(len(y))
                d = np.sqrt(((y[near] - v) ** 2).sum(1))
                pairs = sorted((s, other) for i, s in zip(near, d) for other in ids[i] if other != query)
                out += [(query, other, score) for score, other in pairs[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["part", "i", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_learned_partition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
