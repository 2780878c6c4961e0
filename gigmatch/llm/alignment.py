"""Alignment of two tokenizers' tokens over whole texts, as an Arrow pipeline whose partial counts Spark merges.

A batch of documents is two list columns of token ids.  Flattened, with their parents' indices, each token gets the
byte offset at which it ends by a cumulative sum of token sizes less that of its document's start.  A full outer hash
join of the two sides on (document, end) has a row for every boundary: where both sides end, a group ends; filled
backwards, a row holds the A and the B token that overlap there, and each overlapping pair has exactly one row.
Grouped by document and pair, these are partial counts, which Spark sums over the corpus.

Corpus-wide counts go back to the documents in two ways: those of the HOT most frequent pairs, a bounded table, to
every task; all others, none of which is frequent, by a join.  So no frequent pair is ever shuffled by its key.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmatch.llm.common import bounded, documents, materialise, slices
from gigmatch.llm.token_counts import byte_of
from gigmatch.llm.words import Numbers
from gigmatch.llm.workers import held, lean

#: Pairs whose counts every task holds (17 bytes each).
HOT = 1 << 18
#: Distinct stretches whose ids a worker remembers at most; then it starts anew.
KEPT = 300_000
#: New stretches that are encoded as one text.
TOGETHER = 500
#: Characters of texts that are aligned at once, and bits of an offset in a key of document and offset.
CHARACTERS, OFFSET = 300_000, 40
#: Sentencepiece's mark of a space.
SPACE = "▁"
#: A single space between two characters that no tokenizer could take for one: neither vocabulary's tokens cross it.
_INNER = "[^\\s" + "".join(map(chr, (0x180E, 0x200B, 0xFEFF, 0x2581))) + "]"
_CUT = re.compile(f"(?<={_INNER}) (?={_INNER})")
#: Stretches that begin and end with such characters; next to a space that joins them, others could share tokens.
_JOINS = re.compile(f"{_INNER}(?:.*{_INNER})?", re.DOTALL)


def public_path(name: str) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


class Coder:
    """Ids of both tokenizers for whole texts, and the bytes that tokens stand for.

    Texts are cut at single spaces, where the byte-level pre-tokenizer cuts too and which no piece of the other
    vocabulary holds after another character; each stretch takes its space with it.  Ids of stretches are remembered.
    """

    def __init__(self, byte_level: str, pieces: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_level)
        self.first.encode_special_tokens = True
        self.second = SentencePieceProcessor(model_file=pieces)
        table, vocab = byte_of(), self.first.get_vocab(with_added_tokens=True)
        names: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            names[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
        self.bytes_a = names
        sp = self.second
        shown = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(shown)]
        if any(SPACE in p.lstrip(SPACE) for p in shown):
            raise ValueError("a piece of the vocabulary holds a space after another character")
        self.size_a, self.size_b = (np.array([len(x) for x in names], np.int64) for names in (self.bytes_a, self.bytes_b))
        self.sizes_a, self.sizes_b = pa.array(self.size_a), pa.array(self.size_b)
        self.names_a, self.names_b = (pa.array([b"%d" % i for i in range(len(names))], pa.binary()) for names in (self.bytes_a, self.bytes_b))
        self.shift = max(len(shown) - 1, 1).bit_length()
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.sizes = Numbers(), [0, 0]
        self.good, self.places = [np.zeros(0, bool)], [np.zeros(0, np.int64)]
        self.ids = [[np.zeros(0, np.int32)], [np.zeros(0, np.int32)]]
        self.ends = [[np.zeros(1, np.int64)], [np.zeros(1, np.int64)]]

    def _encoded(self, side: int, stretches: list[str]) -> list[list[int]]:
        if side:
            return self.second.encode(stretches, num_threads=1)
        return [e.ids for e in self.first.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]

    def _learn(self) -> None:
        """Encodes new stretches, many as one text whose tokens can't cross them; one by one where they could, or where that isn't lossless."""
        new = self.numbers.new
        joins = np.array([_JOINS.fullmatch(s) is not None for s in new], bool)
        order, n = np.argsort(~joins, kind="stable"), int(joins.sum())  # they are kept in this order, those that join first
        places = np.empty(len(new), np.int64)
        places[order] = np.arange(len(new)) + sum(map(len, self.good))
        self.places.append(places)
        bounds = [*range(0, n, TOGETHER), *range(n, len(new), TOGETHER), len(new)]
        for start, end in zip(bounds, bounds[1:]):
            part = [new[i] for i in order[start:end].tolist()]
            spaced = [(" " + s).encode("utf-8", "replace") for s in part]
            stops, whole = np.cumsum(list(map(len, spaced))), b"".join(spaced)
            good = np.ones(len(part), bool)
            for side, (names, sizes) in enumerate(((self.bytes_a, self.size_a), (self.bytes_b, self.size_b))):
                got = self._encoded(side, [" ".join(part)])[0] if start < n else []
                if got and b"".join(map(names.__getitem__, got)) == whole:
                    flat = np.array(got, np.int32)
                    ends = np.searchsorted(np.cumsum(sizes[flat]), stops) + 1
                else:
                    lists = self._encoded(side, part)
                    good &= np.array([b"".join(map(names.__getitem__, x)) == s for x, s in zip(lists, spaced)])
                    flat, ends = np.array([i for x in lists for i in x], np.int32), np.cumsum(list(map(len, lists)))
                self.ends[side].append(self.sizes[side] + ends)
                self.ids[side].append(flat)
                self.sizes[side] += len(flat)
            self.good.append(good)
        new.clear()
        self.good, self.places = [np.concatenate(self.good)], [np.concatenate(self.places)]
        self.ids, self.ends = ([[np.concatenate(x)] for x in both] for both in (self.ids, self.ends))

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both sides for each text; none for an empty text or one that either side doesn't keep as it is."""
        if len(self.numbers) > KEPT:
            self._forget()
        look = self.numbers.__getitem__
        cut = [np.array(list(map(look, _CUT.split(t))) if t else [], np.int64) for t in texts]
        self._learn()
        good, cut = self.good[0], [self.places[0][c] for c in cut]
        cut = [c if good[c].all() else c[:0] for c in cut]
        at = np.concatenate(cut) if cut else np.zeros(0, np.int64)
        rows = np.concatenate([[0], np.cumsum([len(c) for c in cut], dtype=np.int64)])
        out = []
        for (ids,), (ends,) in zip(self.ids, self.ends):
            n = ends[at + 1] - ends[at]
            stops = np.concatenate([[0], np.cumsum(n)])
            places = np.repeat(ends[at] - stops[:-1], n) + np.arange(stops[-1])
            out.append(pa.ListArray.from_arrays(pa.array(stops[rows].astype(np.int32)), pa.array(ids[places])))
        return out[0], out[1]


def _ends(ids: pa.ListArray, sizes: pa.Array, name: str) -> pa.Table:
    """(key, id) per token: its document and the offset in it at which the token ends."""
    flat, parent = pc.list_flatten(ids), pc.cast(pc.list_parent_indices(ids), pa.int64())
    total = pc.cumulative_sum(pc.take(sizes, flat))
    starts = np.concatenate([[0], total.to_numpy()])[ids.offsets.to_numpy()[:-1]]
    ends = pc.subtract(total, pc.take(pa.array(starts), parent))
    return pa.table({"key": pc.bit_wise_or(pc.shift_left(parent, OFFSET), ends), name: flat})


def _listed(values: pa.Array, sizes: np.ndarray, mark: bytes) -> pa.Array:
    """Consecutive runs of ``values`` of the given sizes, each joined by ``mark``."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), pa.scalar(mark, pa.binary()))


def align(coder: Coder, first: pa.ListArray, second: pa.ListArray) -> pa.RecordBatch:
    """Per document: token, group and link counts, the digest of its groups, its distinct pairs and how often each links."""
    n = len(first)
    both = _ends(first, coder.sizes_a, "a").join(_ends(second, coder.sizes_b, "b"), "key", join_type="full outer", use_threads=False)
    both = both.combine_chunks().sort_by("key")
    a, b = (both.column(c).combine_chunks() for c in ("a", "b"))
    doc = pc.shift_right(both.column("key").combine_chunks(), OFFSET)
    ends_a, ends_b = (pc.is_valid(c).to_numpy(zero_copy_only=False) for c in (a, b))
    closes = ends_a & ends_b
    places = doc.to_numpy()
    links, groups = np.bincount(places, minlength=n), np.bincount(places[closes], minlength=n)

    number = np.cumsum(closes) - closes
    n_groups = int(closes.sum())
    sides = [
        _listed(pc.take(names, c.filter(pa.array(there))), np.bincount(number[there], minlength=n_groups), b",")
        for names, c, there in ((coder.names_a, a, ends_a), (coder.names_b, b, ends_b))
    ]
    written = _listed(pc.binary_join_element_wise(*sides, pa.scalar(b"|", pa.binary())), groups, b";").to_pylist()

    # Each row is one link: of the tokens of either side that end there or next.
    wide = pa.int64()
    pair = pc.bit_wise_or(pc.shift_left(pc.cast(pc.fill_null_backward(a), wide), coder.shift), pc.cast(pc.fill_null_backward(b), wide))
    counts = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    counts = counts.combine_chunks().sort_by("doc")
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(counts.column("doc").to_numpy(), minlength=n))]).astype(np.int32))
    pairs, times = counts.column("pair").combine_chunks(), pc.cast(counts.column("count_all"), pa.int32()).combine_chunks()
    columns = {
        "n_a": pc.cast(pc.list_value_length(first), wide),
        "n_b": pc.cast(pc.list_value_length(second), wide),
        "n_groups": pa.array(groups.astype(np.int64)),
        "n_links": pa.array(links.astype(np.int64)),
        "groups_sha256": pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written], pa.string()),
        "pairs": pa.ListArray.from_arrays(offsets, pairs),
        "times": pa.ListArray.from_arrays(offsets, times),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


_ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def add_links(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """_row, doc_id and what ``align`` finds for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(f"links of {byte_level} and {pieces}", lambda: Coder(byte_level, pieces))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in slices([len(t) for t in texts], CHARACTERS):
                found = align(coder, *coder.encode(texts[start:end]))
                ids, rows = (batch.column(c).slice(start, end - start) for c in ("doc_id", "_row"))
                yield pa.RecordBatch.from_arrays([rows, ids, *found.columns], ["_row", "doc_id", *found.schema.names])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.monotonically_increasing_id().alias("_row"))
    return rows.mapInArrow(lean(run, "links"), f"_row long, doc_id long, {_ALIGNED}, pairs array<long>, times array<int>")


def pair_counts(linked: DataFrame, shift: int) -> DataFrame:
    """(pair, n, best): how many links hold each pair in the corpus, and whether no pair of its B id has more."""
    each = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = materialise(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "alignment-pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << shift) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row per id of the vocabulary at most
    return counts.join(F.broadcast(highest), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _with_hot(hot):
    """Sums over the links of hot pairs, and the other pairs, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = hot.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times")
            pairs, n = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            rows = pc.list_parent_indices(lists).to_numpy()
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], rows[found], n[found] * best[at[found]])
            np.add.at(sums[1], rows[found], n[found] * counts[at[found]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows[~found], minlength=batch.num_rows))]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pairs[~found], n[~found].astype(np.int32))]
            kept = [batch.column(c) for c in batch.schema.names if c not in ("pairs", "times")]
            names = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums[0]), pa.array(sums[1]), *rest], [*names, "best", "total", "pairs", "times"])

    return run


def align_tokenizers(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    ``byte_level`` (A) takes a space and the text, ``pieces`` (B) the text.  Null and empty texts, and those that the
    tokens don't give back byte by byte, have no tokens: zeros and an empty digest.  Rows that repeat or have a null id
    count each; of pairs with equal counts all are the highest; whole texts are aligned, however long; an empty table
    gives an empty result; further columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    byte_level, pieces = byte_level or public_path("byte_bpe_50k.json"), pieces or public_path("piece_bpe_32k.model")
    from sentencepiece import SentencePieceProcessor

    shift = max(SentencePieceProcessor(model_file=pieces).get_piece_size() - 1, 1).bit_length()
    linked = materialise(add_links(docs, byte_level, pieces), "alignment-links")
    counts = materialise(pair_counts(linked, shift), "alignment-counts")
    top = counts.orderBy(F.desc("n"), "pair").limit(hot).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    summed = materialise(
        linked.mapInArrow(lean(_with_hot(known)), f"_row long, doc_id long, {_ALIGNED}, best long, total long, pairs array<long>, times array<int>"),
        "alignment-sums",
    )
    rest = summed.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(F.col("_row").alias("r"), F.col("x.pairs").alias("p"), F.col("x.times").alias("t"))
    rest = rest.join(counts, F.col("p") == F.col("pair"))
    rest = rest.groupBy("r").agg(F.sum(F.col("t") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("t") * F.col("n")).alias("more"))
    rest = bounded(materialise(rest, "alignment-rest"))
    joined = summed.join(rest, F.col("_row") == F.col("r"), "left")
    with_rest = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).alias({"best": "n_best", "total": "count_sum"}[own])
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", with_rest("best", "more_best"), with_rest("total", "more"), "groups_sha256")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(documents(spark, sf_dir))
