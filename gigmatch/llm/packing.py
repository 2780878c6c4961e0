"""Sequence packing by non-negative least squares.

All pieces' lengths make a histogram of at most as many bins as a sequence has tokens.  On it, patterns of a few
lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by non-negative
least squares and rounded, and what is left over is packed best-fit decreasing, on counts again.  The plan says which
ranks among the pieces of a length go to which pattern; only then are the pieces themselves placed, in parallel.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmatch.llm.common import documents, materialise, slices, with_rank
from gigmatch.llm.words import END, Numbers, default_vocabulary, is_plain, plain_words
from gigmatch.llm.workers import held, lean

CAPACITY = 4096
#: Id put after each document.
END_OF_DOCUMENT = 1
#: Distinct words whose ids a worker remembers at most; then it keeps the frequent ones.
WORDS_KEPT = 300_000
#: New words that are encoded as one text.
TOGETHER = 256
#: Steps of the least-squares fit, and second and third lengths tried in patterns of three and four.
FIT_STEPS, SECOND, THIRD = 200, 32, 8
#: Patterns leave at most this part of a sequence free; looser ones are left to the packing of residuals.
LOOSE = 50


def _with_room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    """``values``, of which the first ``used`` count, or a longer copy with zeros behind them if ``more`` don't fit."""
    if used + more <= len(values):
        return values
    return np.concatenate([values[:used], np.zeros(more + (used + more) // 4, values.dtype)])


class Encoder:
    """Token ids of whole texts.

    The vocabulary's merges never cross words, so ids of a word are asked for once and remembered; texts with
    characters beyond plain Latin go to the tokeniser whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # threads of its own would keep memory each
        from tokenizers import Tokenizer, pre_tokenizers

        self.path = path
        # For plain words alone, which need no normalisation and are cut already: its model is the vocabulary's own.
        self.by_word = Tokenizer.from_file(path)
        self.by_word.normalizer = None
        self.by_word.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.by_word.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for w, i in vocab.items() if w.endswith(END)]] = True
        self._forget()

    @cached_property
    def tokenizer(self):
        """The tokeniser as it is, for texts that aren't plain."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self, keep: list[str] = ()) -> None:
        self.numbers = Numbers()
        # Of word i, flat[ends[i]:ends[i + 1]] are the ids; these arrays have room to grow beyond what is known.
        self.ends, self.flat, self.uses = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for word in keep:
            self.numbers[word]

    def _learn(self) -> None:
        new, ids = self.numbers.new, []
        if not new:
            return
        for i in range(0, len(new), TOGETHER):
            part = new[i : i + TOGETHER]
            got = np.array(self.by_word.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            if np.count_nonzero(self.last[got]) != len(part):
                raise ValueError("the vocabulary doesn't mark word ends")
            ids.append(got)
        flat = np.concatenate(ids)
        known = len(self.numbers) - len(new)
        used = int(self.ends[known])
        self.flat = _with_room(self.flat, used, len(flat))
        self.flat[used : used + len(flat)] = flat
        self.ends, self.uses = _with_room(self.ends, known + 1, len(new)), _with_room(self.uses, known, len(new))
        self.ends[known + 1 : len(self.numbers) + 1] = used + np.flatnonzero(self.last[flat]) + 1
        new.clear()

    def _trim(self) -> None:
        if len(self.numbers) > WORDS_KEPT:
            names = list(self.numbers)
            uses = self.uses[: len(names)]
            often = np.flatnonzero(uses >= max(3, np.sort(uses)[-WORDS_KEPT // 2]))
            self._forget([names[i] for i in often])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        self._trim()
        plain = [plain_words(t) if is_plain(t) else None for t in texts]
        look = self.numbers.__getitem__
        known = [None if w is None else np.fromiter(map(look, w), np.int64, len(w)) for w in plain]
        self._learn()
        out = []
        for text, at in zip(texts, known):
            if at is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            first = self.ends[at]
            n = self.ends[at + 1] - first
            np.add.at(self.uses, at, 1)
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(first - (ends - n), n) + np.arange(total)])
        return out


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Token pieces of every whole text: doc_id, piece, start, length, ids_crc32 and, with ``ids``, the ids.

    Null text counts as empty: its only token is the end mark.  Documents longer than ``capacity`` are cut there.
    """
    path = path or default_vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(f"ids of {path}", lambda: Encoder(path))
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for first, last in slices([len(t) for t in texts], 2_000_000):
                rows = []
                for doc_id, got in zip(doc_ids[first:last], coder.encode(texts[first:last])):
                    whole = np.append(got, np.uint32(END_OF_DOCUMENT)).astype("<u4")
                    for n, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        rows.append((doc_id, n, start, len(part), zlib.crc32(part.tobytes()), part))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                if ids:
                    columns.append(pa.array([r[5].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run, "ids"), schema)


def candidate_patterns(counts: np.ndarray) -> np.ndarray:
    """Patterns of up to four lengths, one per row, padded with zeros; the last length fills up as far as one can.

    The first length runs over all that occur; in patterns of three and four, second and third lengths run over
    quantiles of the occurring ones; the last is the longest occurring one that still fits.
    """
    capacity = len(counts) - 1
    there = np.flatnonzero(counts[:capacity])
    if not len(there):
        return np.zeros((0, 4), np.int64)
    mass = np.cumsum(counts[there])
    fitting = np.zeros(capacity + 1, np.int64)  # the longest occurring length up to each
    fitting[there] = there
    fitting = np.maximum.accumulate(fitting)

    def spread(n: int) -> np.ndarray:
        return np.unique(there[np.minimum(np.searchsorted(mass, (np.arange(n) + 0.5) / n * mass[-1]), len(there) - 1)])

    out = []
    for inner in ((), (spread(SECOND),), (spread(THIRD), spread(THIRD))):
        rows = np.stack([x.ravel() for x in np.meshgrid(there, *inner, indexing="ij")], 1)
        left = capacity - rows.sum(1)
        rows = np.concatenate([rows, fitting[np.maximum(left, 0)][:, None]], 1)[left >= 0]
        rows = rows[capacity - rows.sum(1) <= capacity // LOOSE]
        out.append(np.pad(np.sort(rows, 1)[:, ::-1], ((0, 0), (0, 4 - rows.shape[1]))))
    return np.unique(np.concatenate(out), axis=0)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths closest to the histogram, by accelerated projected gradient.

    Each length's error is weighted by the length over the square root of its count: tokens left over are what costs.
    """
    size = len(counts)
    scale = np.where(counts > 0, np.arange(size) / np.sqrt(np.maximum(counts, 1)), 0.0)
    flat, n = patterns.ravel(), len(patterns)

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, 4), size)
        out[0] = 0
        return out

    def gradient(x: np.ndarray) -> np.ndarray:
        error = (forward(x) - counts) * scale**2
        error[0] = 0
        return error[patterns].sum(1)

    probe = np.ones(n)
    for _ in range(20):
        back = forward(probe) * scale**2
        back[0] = 0
        probe = back[patterns].sum(1)
        top = np.linalg.norm(probe)
        probe = probe / max(top, 1e-30)
    step, x, y, t = 1 / max(top, 1e-30), np.zeros(n), np.zeros(n), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * gradient(y))
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / faster * (new - x), faster
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on counts: sequences as (pieces by length, repeats), so the work doesn't grow with rows."""
    open_by_space: dict[int, list[tuple[dict[int, int], int]]] = {}
    ready = np.zeros(capacity + 1, bool)

    def put(space: int, held: dict[int, int], repeats: int) -> None:
        open_by_space.setdefault(space, []).append((held, repeats))
        ready[space] = True

    for length in range(capacity, 0, -1):
        left = int(counts[length]) if length < len(counts) else 0
        while left:
            fits = np.argmax(ready[length:]) + length if ready[length:].any() else 0
            if not fits:
                each = capacity // length
                if left >= each:
                    put(capacity - each * length, {length: each}, left // each)
                if left % each:
                    put(capacity - left % each * length, {length: left % each}, 1)
                break
            held, repeats = open_by_space[fits].pop()
            each = min(fits // length, left)
            used = min(repeats, left // each)
            if repeats > used:
                open_by_space[fits].append((held, repeats - used))
            ready[fits] = bool(open_by_space[fits])
            put(fits - each * length, held | {length: held.get(length, 0) + each}, used)
            left -= each * used
    return [x for group in open_by_space.values() for x in group]


def plan(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Sequences for a histogram (index: length): pieces by length, and how often that sequence is made."""
    capacity, left = len(counts) - 1, counts.astype(np.int64).copy()
    out = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = candidate_patterns(left)
    if len(patterns):
        repeats = fit_repeats(patterns, left.astype(float))
        # Rounded counts are taken up longest length first, as long pieces have the fewest partners.
        for i in np.lexsort((-repeats, -patterns[:, 0])):
            if repeats[i] < 0.5:
                continue
            lengths, each = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            n = int(min(np.rint(repeats[i]), (left[lengths] // each).min()))
            if n > 0:
                left[lengths] -= n * each
                out.append(({int(a): int(b) for a, b in zip(lengths, each)}, n))
    return out + best_fit(left, capacity)


def _segments(sequences: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length in each, offset), by length and rank."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for held, repeats in sequences:
        offset = 0
        for length, each in sorted(held.items(), reverse=True):
            rows.append((length, used.get(length, 0), first, each, offset))
            used[length] = used.get(length, 0) + each * repeats
            offset += length * each
        first += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, ties: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) plus sequence_id and offset; no sequence exceeds ``capacity``.

    What goes through the driver is a histogram: one row per length and per range partition.  Pieces equal in length
    and ``ties`` are alike, so any order among them serves.  An empty table gives an empty result.
    """
    names = pieces.columns
    ranked = with_rank(pieces, ["length", *ties], "pack-ranked")
    runs = (
        ranked.groupBy("_pid", "length")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("at"))
        .orderBy("_pid", "length")
        .toPandas()
    )
    counts = np.bincount(runs["length"].to_numpy(np.int64), runs["n"], capacity + 1).astype(np.int64)
    segments = _segments(plan(counts))
    key = (runs["_pid"].to_numpy(np.int64) << 20) | runs["length"].to_numpy(np.int64)
    base = (runs.groupby("length")["n"].cumsum() - runs["n"] - runs["at"]).to_numpy(np.int64)
    seg_key = (segments[:, 0] << 40) | segments[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pid, pos, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_pid", "_pos", "length"))
            rank = pos + base[np.searchsorted(key, (pid.astype(np.int64) << 20) | length)]
            _, first_rank, first, each, offset = segments[np.searchsorted(seg_key, (length << 40) | rank, "right") - 1].T
            copy, place = np.divmod(rank - first_rank, each)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(first + copy), pa.array(offset + place * length)], [*names, "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(lean(run), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """All documents of ``docs`` tokenised, cut and packed."""
    return pack(materialise(token_pieces(docs, path, capacity), "pack-pieces"), capacity)


def op10_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
