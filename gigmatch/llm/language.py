"""Language identification with bit-sliced Bloom filters.

One slot of the filter is a bit mask with a bit per language, so the masks at an n-gram's few positions, united by
AND, give at once all languages that contain it.  A text's languages are scored by how many of its n-grams carry
their bit, corrected for the hits that a filter of that filling gives by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmatch.llm.common import apart, documents, drop_rows, id_remainder, materialise, slices, with_rows
from gigmatch.llm.workers import lean

ORDERS = (3, 4)
HASHES = 3
#: Expected number of training documents per language (the only sample here); n-grams in fewer than this share of
#: them are not entered, so that foreign passages don't spoil a language's filter.
TRAIN_DOCS, LEAST_SHARE = 800, 0.02
#: Filter slots per entered n-gram, before rounding up to a power of two.
SLOTS = 16
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _TABLE:
        table = np.zeros(0x110000, bool)
        for first, end in ((0, 0xD800), (0xE000, 0x110000)):  # all but the surrogates
            for run in regex.finditer(r"\p{L}+", "".join(map(chr, range(first, end)))):
                table[first + run.start() : first + run.end()] = True
        _TABLE.append(table)
    return _TABLE[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of lower-cased words, word boundaries included, and the number of the text of each."""
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    letter = _letters()[points]
    values = np.where(letter, points, 0).astype(np.uint64) + np.uint64(1)
    hashes, owners = [], []
    for n in ORDERS:
        size = len(values) - n + 1
        if size <= 0:
            continue
        inside = letter[1 : 1 + size].copy()
        for j in range(2, n - 1):
            inside &= letter[j : j + size]
        h = np.full(size, n, np.uint64)
        for j in range(n):
            h = (h ^ values[j : j + size]) * _FACTORS[j]
        h = h[inside]
        h ^= h >> np.uint64(29)
        h *= _FACTORS[0]
        h ^= h >> np.uint64(32)
        hashes.append(h)
        owners.append(owner[:size][inside])
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


@dataclass
class Filters:
    """``masks``: slots by bytes of language bits; ``chance``: each language's false positive rate."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray

    def slots(self, h: np.ndarray) -> list[np.ndarray]:
        """Positions of each n-gram: steps of one odd stride, both taken from its hash, for filters of any size."""
        low, stride = np.uint64(len(self.masks) - 1), (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(j) * stride) & low).astype(np.int64) for j in range(HASHES)]

    def score(self, texts: list[str]) -> np.ndarray:
        """Corrected n-gram hits: one row per text, one column per language."""
        h, owner = grams(texts)
        found = None
        for at in self.slots(h):
            found = self.masks[at] if found is None else found & self.masks[at]
        n = np.bincount(owner, minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            hits = np.bincount(owner[(found[:, k // 8] >> np.uint8(k % 8)) & 1 == 1], minlength=len(texts))
            out[:, k] = np.maximum(0, hits - n * self.chance[k]) / (1 - self.chance[k])
        return out


def build_filters(entries: dict[str, np.ndarray]) -> Filters:
    languages = sorted(entries)
    most = max([1, *(len(v) for v in entries.values())])
    size = 1 << max(10, (SLOTS * most - 1).bit_length())  # grows with what is entered, so that no filter fills up
    filters = Filters(languages, np.zeros((size, max(1, -(-len(languages) // 8))), np.uint8), np.zeros(len(languages)))
    for k, name in enumerate(languages):
        for at in filters.slots(entries[name]):
            filters.masks[at, k // 8] |= np.uint8(1 << k % 8)
        filled = np.count_nonzero((filters.masks[:, k // 8] >> np.uint8(k % 8)) & 1) / size
        filters.chance[k] = min(filled**HASHES, 0.99)
    return filters


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, least_share: float = LEAST_SHARE) -> Filters:
    """Filters from ``docs`` (doc_id, text, lang): about ``train_docs`` rows per language, by a hash of the id."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return build_filters({})
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, train_docs / n))])
    chosen = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
            for start, end in slices([len(t) for t in texts], 1_000_000):
                h, owner = grams(texts[start:end])
                for lang in sorted(set(langs[start:end])):
                    mine = langs[start:end][owner] == lang
                    pairs = np.unique(np.stack([h[mine], owner[mine].astype(np.uint64)], 1), axis=0)
                    gram, n = np.unique(pairs[:, 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
                    )

    grown = known.filter(chosen).select("lang", "text").mapInArrow(lean(run), "lang string, gram long, n long")
    counts = grown.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.element_at(
        F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, max(1.0, least_share * min(n, train_docs)))]),
        F.col("lang"),
    )
    kept = counts.filter(F.col("n") >= least).select("lang", "gram").toPandas()
    entries = {lang: kept["gram"][kept["lang"] == lang].to_numpy(np.int64).view(np.uint64) for lang in totals}
    return build_filters(entries)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text).

    ``und`` with score 0 for texts that are null or have no letter, or if no language was learned; ties go to the
    first language in order.  The score is the winner's share if each corrected hit is worth one unit of log odds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if filters.languages:
                for start, end in slices([len(t or "") for t in texts], 500_000):
                    hits = filters.score([t or "" for t in texts[start:end]])
                    best = hits.argmax(1)
                    top = hits.max(1)
                    share = 1 / np.exp(np.maximum(hits - top[:, None], -700)).sum(1)
                    for i in range(start, end):
                        if texts[i] and _LETTER.search(texts[i]):
                            langs[i], scores[i] = filters.languages[best[i - start]], share[i - start]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose id's remainder by 4 isn't 2 and whose text and lang aren't null, predict all.

    One row per row of ``docs`` (doc_id, text, lang), repeated rows and null ids (not held out) included; the same
    text gets the same prediction.  Whole texts count, however long.  Null and empty texts and texts without a letter
    are ``und`` with score 0, as are all if nothing was learned; ties go to the first language in order.  An empty
    table gives an empty result; further columns, whatever their names, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    return predict(rows, train(rows.filter(id_remainder(F.col("doc_id"), 4) != 2)))


@apart
def keep_known(docs: DataFrame, least_score: float, stored: bool = False) -> DataFrame:
    """``docs`` without the rows whose language is unknown or scored below ``least_score``, all columns as they were.

    Each row is decided by its own text.  ``stored``: ``docs`` reads files and repeats no row of them; else a copy is
    written.
    """
    rows = with_rows(docs, "language-rows", stored)
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "_row")
    filters = train(texts.filter(id_remainder(F.col("doc_id"), 4) != 2))
    found = predict(texts.select(F.col("_row").alias("doc_id"), "text"), filters)
    refused = found.filter((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least_score))
    return drop_rows(rows, materialise(refused.select(F.col("doc_id").alias("_row")), "language-refused"), "language-gone")


def op4_bloom_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
