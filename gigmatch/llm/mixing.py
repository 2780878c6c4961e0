"""Mixing documents to target weights with soft membership in domains.

A classifier fitted on a labelled table gives every document posterior probabilities over the domains.  Projected
gradient least squares then fits nonnegative document rates whose expected token totals per domain match the
targets; rates start at 1, so the fit changes them no more than it has to.  Tokens are the greedy
longest-match pieces of ``token_counts``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmatch.llm.common import apart, bitmaps, documents, has_bit, marked, materialise, slices, with_rows
from gigmatch.llm.features import NAMES, line_features
from gigmatch.llm.token_counts import STOP, Automaton, load_pieces
from gigmatch.llm.words import Numbers, default_vocabulary, words
from gigmatch.llm.workers import held, lean

#: Domains in the order of the posteriors, and the shares of all tokens that they are to have.
TARGETS = {"clean": 0.91, "low": 0.05, "toxic": 0.04}
#: Expected number of labelled training documents, words taken as features at most, and the least gain (in nats over
#: the sample) that keeps chance out of them.
TRAIN_DOCS, WORDS, LEAST_GAIN = 6000, 300, 8.0
#: Training documents of a domain that has so many, however rare it is among the labels; a rarer one gives all.
LEAST_DOCS = 200
#: Part of the first domain's expected tokens that a bounded fit may lose at most.
LOSS = 0.03
EPOCHS, RATE = 300, 0.05
#: Of the training documents, every so many-th is held out to calibrate the posteriors.
HELD_OUT = 5
#: Gain in log likelihood that one more parameter needs (the likelihood ratio test's five per cent).
LEAST_EVIDENCE = 1.92
#: Distinct words whose token counts a worker remembers at most; then it starts anew.
WORDS_KEPT = 150_000
#: The fit ends at this largest relative error of a domain's total, or after so many steps.
TOLERANCE, STEPS = 1e-4, 30


def label_domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "clean")


class WordTable:
    """Words numbered as they are met: the tokens of each, and the feature that it is (-1: none)."""

    def __init__(self, path: str, features: dict[str, int]) -> None:
        self.automaton, self.features = Automaton(load_pieces(path)), features
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.tokens, self.feature = Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the words of each text."""
        if len(self.numbers) > WORDS_KEPT:
            self._forget()
        get = self.numbers.__getitem__
        at = [np.fromiter(map(get, found), np.int64, len(found)) for found in map(words, texts)]
        if new := self.numbers.new:
            self.tokens = np.append(self.tokens, [self.automaton.count([*w.encode(), STOP]) for w in new])
            self.feature = np.append(self.feature, [self.features.get(w, -1) for w in new])
            new.clear()
        return at


def _shape(texts: list[str]) -> np.ndarray:
    """Length-weighted means of the line features of each text."""
    out = [np.zeros((0, len(NAMES)))]
    for start, end in slices([len(t) for t in texts], 500_000):
        table, length, lines = line_features(texts[start:end])
        first = np.cumsum(lines) - lines
        out.append(np.add.reduceat(table * length[:, None], first) / np.add.reduceat(length, first)[:, None])
    return np.concatenate(out)


@dataclass
class DomainModel:
    domains: list[str]
    words: dict[str, int]
    scale: np.ndarray
    weights: np.ndarray
    #: Domains that training documents had, and by how many nats held-out labels are likelier than by base rates.
    seen: set[str] = field(default_factory=set)
    gain: float = np.inf

    def features(self, texts: list[str], table: WordTable, numbers: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.words) + 1))
        for i, found in enumerate(numbers):
            x[i, table.feature[found]] = 1  # the last column takes the words that are no feature
        return np.concatenate([x[:, :-1], _shape(texts) / self.scale, np.ones((len(texts), 1))], 1)

    def look(self, texts: list[str], path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Features and tokens of each text."""
        path = path or default_vocabulary()
        table = held(f"domains {hash(tuple(self.words))} of {path}", lambda: WordTable(path, self.words))
        numbers = table.look(texts)
        return self.features(texts, table, numbers), np.array([table.tokens[found].sum() for found in numbers], np.int64)

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        out = features @ self.weights
        p = np.exp(out - out.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def telling_words(sample: DataFrame, domains: list[str], most: int = WORDS) -> list[str]:
    """The words of ``sample`` (text, domain) whose presence tells most about the domain, counted in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, domain in zip(batch.column("text").to_pylist(), batch.column("domain").to_pylist()):
                bag = sorted(set(words(text or "")))
                yield pa.RecordBatch.from_arrays([pa.array(bag, pa.string()), pa.array([domain] * len(bag), pa.string())], ["word", "domain"])

    totals = {r["domain"]: r["n"] for r in sample.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = max(sum(totals.values()), 1)
    seen = sample.select("text", "domain").mapInArrow(lean(run), "word string, domain string")
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in domains])
    gain = F.lit(0.0)
    for d in domains:
        share = max(totals.get(d, 0) / whole, 1e-12)
        gain = gain + F.when(F.col(f"n_{d}") > 0, F.col(f"n_{d}") * F.log(F.col(f"n_{d}") / F.col("n") / share)).otherwise(0.0)
    top = counts.filter("n >= 5").select("word", F.round(gain, 9).alias("gain")).filter(F.col("gain") >= LEAST_GAIN).orderBy(F.desc("gain"), "word").limit(most)
    return [r["word"] for r in top.collect()]


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    weights, target = np.zeros((x.shape[1], classes)), np.eye(classes)[y]
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, EPOCHS + 1):
        out = x @ weights
        p = np.exp(out - out.max(1, keepdims=True))
        g = x.T @ (p / p.sum(1, keepdims=True) - target) / len(x) + 1e-4 * weights
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weights = weights - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return weights


def calibration(out: np.ndarray, y: np.ndarray) -> float:
    """The factor on log odds under which held-out labels are most likely, from 1/8 to 2.

    It stays 1 unless another one makes them likelier by ``LEAST_EVIDENCE`` nats: small samples say little.
    """
    factors = 2.0 ** np.linspace(-3, 1, 33)

    loss = lambda f: _log_loss(out * f, y)
    best = min(factors, key=loss)
    return float(best) if loss(1.0) - loss(best) >= LEAST_EVIDENCE else 1.0


def _log_loss(out: np.ndarray, y: np.ndarray) -> float:
    z = out - out.max(1, keepdims=True)
    return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).sum())


def train(docs: DataFrame, labels: DataFrame, domains: list[str], train_docs: int = TRAIN_DOCS) -> DomainModel:
    """Softmax regression on line shapes and telling words of about ``train_docs`` labelled documents, by a hash of the id,
    and of ``LEAST_DOCS`` of each domain or all that it has.

    Texts stay in the cluster; the driver gets one feature vector per training document.  How sure the posteriors are
    is set on a part of these documents that a first fit leaves out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    known = known.filter(F.col("domain").isin(domains))
    counts = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per domain
    even = min(1.0, train_docs / max(sum(counts.values()), 1))
    shares = {d: max(even, min(1.0, LEAST_DOCS / n)) for d, n in counts.items()}
    share = F.lit(0.0)
    for d, x in shares.items():
        share = F.when(F.col("domain") == d, x).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    chosen = chosen.groupBy("doc_id").agg(F.max("domain").alias("domain"))  # about train_docs rows
    sample = materialise(docs.join(F.broadcast(chosen), "doc_id").select("text", "domain"), "mix-sample")
    telling = telling_words(sample, domains)
    model = DomainModel(domains, {w: i for i, w in enumerate(telling)}, np.ones(len(NAMES)), np.zeros((len(telling) + len(NAMES) + 1, len(domains))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in slices([len(t) for t in texts], 500_000):
                rows = [r.tobytes() for r in model.look(texts[start:end])[0].astype(np.float32)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("domain").slice(start, end - start)], ["x", "domain"])

    rows = sorted((bytes(r["x"]), r["domain"]) for r in sample.mapInArrow(lean(run, "domains"), "x binary, domain string").collect())
    model.seen = {d for _, d in rows}
    if rows:
        x = np.stack([np.frombuffer(r, np.float32) for r, _ in rows]).astype(float)
        shapes = slice(len(telling), len(telling) + len(NAMES))
        model.scale = np.maximum(x[:, shapes].std(0), 1e-3)
        x[:, shapes] /= model.scale
        y = np.array([domains.index(d) for _, d in rows])
        model.weights = fit_softmax(x, y, len(domains))
        out = np.arange(len(y)) % HELD_OUT == 0  # rows are in the order of their features
        if len(np.unique(y[~out])) == len(np.unique(y)) > 1 and out.sum() >= 20:
            scores = x[out] @ fit_softmax(x[~out], y[~out], len(domains))
            factor = calibration(scores, y[out])
            model.weights = model.weights * factor
            base = np.bincount(y[~out], minlength=len(domains)) / (~out).sum()
            model.gain = float(np.log(base[y[out]]).sum() * -1 - _log_loss(scores * factor, y[out]))
        # A domain of which a larger share was taken is that much rarer in truth; the last feature is 1.
        model.weights[-1] -= np.log([shares.get(d, 1.0) / max(shares.values()) for d in domains])
    return model


def memberships(docs: DataFrame, model: DomainModel, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key`` (long), tokens and p, the posterior of each domain, for every row of ``docs`` (``key``, text)."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for start, end in slices([len(t) for t in texts], 1_000_000):
                x, tokens = model.look(texts[start:end], path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(start, end - start), pa.array(tokens), pa.array(list(model.posteriors(x)))],
                    [key, "tokens", "p"],
                )

    return docs.select(key, "text").mapInArrow(lean(run, "domains"), f"{key} long, tokens long, p array<double>")


def rate(p: Column, steps: list[list[float]], most: float | None = None) -> Column:
    """A document's rate after the fit's steps: 1, then in each step less the inner product with its vector, held at 0.

    With ``most`` it is held at that as well.
    """
    if not steps:
        return F.lit(1.0)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in steps])

    def move(now: Column, step: Column) -> Column:
        change = F.aggregate(F.zip_with(p, step, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        moved = F.greatest(F.lit(0.0), now - change)
        return moved if most is None else F.least(F.lit(float(most)), moved)

    return F.aggregate(table, F.lit(1.0), move)


def fit_rates(members: DataFrame, targets: list[float], total: float | None = None) -> tuple[list[list[float]], dict]:
    """Steps of the projected gradient fit of nonnegative rates; ``rate`` replays them for a document.

    A document's weight in the geometry of the fit is its token count, so long and short documents of equal
    posteriors get equal rates.  The gradient is scaled by the inverse Gram matrix of the documents that are not held
    at 0, so overlapping domains don't slow each other down; a step that makes the error larger is halved.  One
    aggregation over ``members`` per step brings back a few numbers per pair of domains.  Without ``total``, the
    first domain's expected tokens are kept and the others follow.
    """
    n = len(targets)
    pairs = [(i, j) for i in range(n) for j in range(n)]

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rows = members.select("tokens", "p", rate(F.col("p"), steps).alias("r"))
        at = lambda k: F.get("p", F.lit(k))
        sums = [F.sum(F.col("tokens") * at(k) * F.col("r")) for k in range(n)]
        gram = [F.sum(F.when(F.col("r") > 0, F.col("tokens") * at(i) * at(j))) for i, j in pairs]
        got = np.array([float(x or 0) for x in rows.agg(*sums, *gram).first()])
        return got[:n], got[n:].reshape(n, n)

    now, gram = totals([])
    have = now
    want = np.array(targets) * (total if total is not None else have[0] / targets[0])
    scale = np.maximum(np.where(want > 0, want, have), 1e-9)  # errors are relative to what is wanted
    steps: list[list[float]] = []
    for _ in range(STEPS):
        error = np.abs((now - want) / scale).max()
        if not have.any() or error <= TOLERANCE:
            break
        step, _, _, _ = np.linalg.lstsq(gram, now - want, rcond=1e-9)
        for _ in range(6):
            after, free = totals([*steps, step.tolist()])
            if np.abs((after - want) / scale).max() < error:
                break
            step = step / 2
        steps.append(step.tolist())
        now, gram = after, free
    return steps, {"have": have.tolist(), "want": want.tolist(), "got": now.tolist(), "steps": len(steps)}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, total: float | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain> and rate of every row of ``docs``; rates may be above 1 (see ``draw_copies``).

    Null and empty texts have no tokens: they count for no total and keep the rate of their posteriors.  Rows alike
    in text get equal rates, repeated ids and null ids or not.  Without labelled documents all posteriors are equal.
    An empty table gives an empty result; further columns, whatever their names, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = materialise(memberships(rows, train(rows, labels, list(targets))), "mix-members")
    steps, _ = fit_rates(members, list(targets.values()), total)
    shown = [F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(targets)]
    return members.select("doc_id", "tokens", *shown, rate(F.col("p"), steps).alias("rate"))


def fit_kept(members: DataFrame, targets: list[float], most: float = 1.0) -> tuple[list[list[float]], dict]:
    """Steps of a fit like ``fit_rates`` with rates held in [0, ``most``].

    No domain is wanted beyond ``most`` times what it has: a scarce one keeps its documents (at 1), and no other is
    lowered in its stead.  Totals that no such rates meet are approached until a step no longer lowers the largest
    error by a hundredth, or would lose more than ``LOSS`` of the first domain's tokens.
    """
    n = len(targets)

    def totals(steps: list[list[float]]) -> tuple[np.ndarray, list[np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(n + 2 * n * n)
            for batch in batches:
                if not batch.num_rows:
                    continue
                tokens = batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)
                p = batch.column("p").flatten().to_numpy().reshape(-1, n)
                r = np.ones(len(p))
                for step in steps:
                    r = np.clip(r - p @ np.array(step), 0.0, most)
                weighed = p * tokens[:, None]
                above, inside = r > 0, (r > 0) & (r < most)
                out += np.concatenate([r @ weighed, (weighed[inside].T @ p[inside]).ravel(), (weighed[above].T @ p[above]).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([float(x)]) for x in out], [f"s{k}" for k in range(len(out))])

        names = [f"s{k}" for k in range(n + 2 * n * n)]
        parts = members.select("tokens", "p").mapInArrow(lean(run), ", ".join(f"{x} double" for x in names))
        got = np.array([float(x or 0) for x in parts.agg(*[F.sum(x) for x in names]).first()])
        return got[:n], [g.reshape(n, n) for g in (got[n : n + n * n], got[n + n * n :]) if g.any()]

    now, grams = totals([])
    have = now
    want = np.minimum(np.array(targets) * have[0] / targets[0], have * most)
    scale = np.maximum(np.where(want > 0, want, have), 1e-9)
    steps: list[list[float]] = []
    error = np.abs((now - want) / scale).max()
    while len(steps) < STEPS and error > TOLERANCE:
        best = None
        for gram in grams:  # of the documents between the bounds, then of all that are not held at 0
            step, _, _, _ = np.linalg.lstsq(gram, now - want, rcond=1e-9)
            for _ in range(6):
                after, free = totals([*steps, step.tolist()])
                left = np.abs((after - want) / scale).max()
                if left < error and after[0] >= (1 - LOSS) * want[0]:
                    best = step, after, free, left
                    break
                step = step / 2
            if best is not None:
                break
        if best is None:
            break
        step, now, grams, left = best
        steps.append(step.tolist())
        small, error = error - left < 0.01 * error, left
        if small:
            break
    return steps, {"have": have.tolist(), "want": want.tolist(), "got": now.tolist(), "steps": len(steps)}


def kept_rates(rows: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float = 1.0) -> DataFrame:
    """_row and rate, from 0 to ``most``, of every row (of ``with_rows``).

    All are 1 if no labelled document has one of the domains, or if held-out labels are no likelier by the posteriors
    than by base rates: what can't be told apart isn't mixed.
    """
    texts = rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(texts.select("doc_id", "text"), labels, list(targets))
    if model.seen != set(targets) or model.gain < LEAST_EVIDENCE:
        return texts.select("_row", F.lit(1.0).alias("rate"))
    members = materialise(memberships(texts, model, "_row"), "mix-members")
    steps, _ = fit_kept(members, list(targets.values()), most)
    return members.select("_row", rate(F.col("p"), steps, most).alias("rate"))


def draw_copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """``rows`` (of ``with_rows``) without ``_row``, each as often as its rate (_row, rate) says, on average.

    The whole part of a rate is certain, the rest is drawn by a hash of the row's id (without one, of its place).
    Copies are marked by one bitmap per count, so texts are never shuffled.
    """
    drawn = rows.select("_row", F.coalesce(F.col("doc_id").cast("long"), F.col("_row")).alias("by")).join(rates, "_row")
    draw = F.pmod(F.xxhash64(F.col("by"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("rate")
    times = (whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    counted = materialise(drawn.select("_row", times.alias("times")).filter("times <> 1"), "mix-times")
    kinds = sorted(r["times"] for r in counted.select("times").distinct().collect())  # at most the largest rate's number
    if not kinds:
        return rows.drop("_row", "_file")
    flags = bitmaps(counted, "mix-bits", ["times"])
    wide = flags.groupBy("_bucket").agg(*[F.max(F.when(F.col("times") == k, F.col("_bits"))).alias(f"_bits_{k}") for k in kinds])
    held = [has_bit(F.col(f"_bits_{k}"), F.col("_row")) for k in kinds]
    many = F.lit(1)
    for k, flag in zip(kinds, held):
        many = F.when(flag, F.lit(k)).otherwise(many)
    repeat = lambda df: df.withColumn("_copies", many).filter("_copies > 0").select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    once = lambda df: df.filter(many > 0).select(*rows.columns)
    return marked(rows, materialise(wide, "mix-flags"), [f"_bits_{k}" for k in kinds], repeat if kinds[-1] > 1 else once).drop("_row", "_file", "_copy")


@apart
def sample_by_rate(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float = 1.0, stored: bool = False) -> DataFrame:
    """``docs`` with each row as often as its own ``kept_rates`` say; with ``most`` at 1, none is repeated.

    ``stored``: ``docs`` reads files and repeats no row of them; else a copy is written.
    """
    rows = with_rows(docs, "mix-rows", stored)
    return draw_copies(rows, kept_rates(rows, labels, targets, most))


def op8_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
