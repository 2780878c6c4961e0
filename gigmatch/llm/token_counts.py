"""Greedy longest-match token counts in linear time.

The vocabulary is a trie; each node has a failure link, taken when no child fits the next symbol, and the number of
pieces that greedy matching has then popped.  One left-to-right walk per word gives the number of its pieces without
building any, and no symbol is read twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gigmatch.llm.common import documents, slices
from gigmatch.llm.words import END, Numbers, default_vocabulary, words
from gigmatch.llm.workers import held, lean

#: Distinct words whose counts a worker remembers at most; then it starts anew.
WORDS_KEPT = 500_000
#: Symbol after a word's bytes.
STOP = 256


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others follow in order from U+0100 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_pieces(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary with word ends, as symbols: bytes, and STOP for the end mark."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    table = byte_of()
    out = []
    for piece in vocab:
        body, stop = (piece[: -len(END)], (STOP,)) if piece.endswith(END) else (piece, ())
        if all(c in table for c in body):
            out.append(tuple(table[c] for c in body) + stop)
    return out


class Automaton:
    """``first`` are pieces that may begin a word, ``later`` those that may continue one (the same, if None)."""

    def __init__(self, first: Iterable[tuple[int, ...]], later: Iterable[tuple[int, ...]] | None = None) -> None:
        self.child: dict[int, int] = {}
        self.root, self.inner = 0, 0 if later is None else 1
        self.size = self.inner + 1
        parent, symbol, depth, whole = [-1] * self.size, [0] * self.size, [0] * self.size, {}
        for root, pieces in ((self.root, first), *(() if later is None else ((self.inner, later),))):
            for piece in pieces:
                node = root
                for s in piece:
                    key = node << 9 | s
                    if key not in self.child:
                        self.child[key] = self.size
                        parent.append(node)
                        symbol.append(s)
                        depth.append(depth[node] + 1)
                        self.size += 1
                    node = self.child[key]
                if piece:
                    whole[node] = True
        self.fail = [-1] * self.size
        self.popped = [0] * self.size
        for node in sorted(range(self.inner + 1, self.size), key=depth.__getitem__):
            if node in whole:
                self.fail[node], self.popped[node] = self.inner, 1
                continue
            back, count = self.fail[parent[node]], self.popped[parent[node]]
            while back >= 0 and back << 9 | symbol[node] not in self.child:
                count += self.popped[back]
                back = self.fail[back]
            if back >= 0:
                self.fail[node], self.popped[node] = self.child[back << 9 | symbol[node]], count

    def count(self, symbols: Iterable[int]) -> int:
        """Number of greedy longest-match pieces; 1 (unknown) where greedy matching gets stuck, 0 for no symbols."""
        node, total, child, fail, popped = self.root, 0, self.child, self.fail, self.popped
        for s in symbols:
            while (after := child.get(node << 9 | s, -1)) < 0:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = after
        while node != self.inner and node != self.root:
            total += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


def _loaded(path: str) -> tuple[Automaton, Numbers, list[int]]:
    automaton, numbers, counts = held(f"counts of {path}", lambda: (Automaton(load_pieces(path)), Numbers(), []))
    if len(numbers) > WORDS_KEPT:
        numbers.clear()
        counts.clear()
    return automaton, numbers, counts


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens per row of ``docs``: greedy longest-match pieces of every word of the whole text.

    Null and empty texts have no words; whole texts count, however long.  Words are cut as the vocabulary's
    pre-tokeniser does; greedy pieces are the longest that fit from the left (there are no ties), which need not be
    the pieces that its merges would give.  Repeated rows and null ids give a row each; an empty table gives an empty
    result; further columns, whatever their names, are not read.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_words, n_tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for start, end in slices([len(t or "") for t in texts], 2_000_000):
                automaton, numbers, counts = _loaded(path)
                for i in range(start, end):
                    found = words(texts[i] or "")
                    at = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
                    counts.extend(automaton.count([*w.encode(), STOP]) for w in numbers.new)
                    numbers.new.clear()
                    n_words[i] = len(found)
                    n_tokens[i] = sum(map(counts.__getitem__, at.tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_tokens)], ["doc_id", "n_words", "n_tokens"]
            )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(lean(run, "counts"), "doc_id long, n_words long, n_tokens long")


def op3_longest_match_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
