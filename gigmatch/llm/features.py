"""Line features of whole texts, computed on the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

#: Columns of ``line_features``.
NAMES = (
    "upper", "symbol", "bang", "bar", "digit", "mark", "space", "word_length",
    "same_as_last_word", "repeated_line", "length", "long", "wide",
)

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 symbol, 3 bang, 4 bar, 5 digit, 6 other mark, 7 space
for _chars, _number in (
    (bytes(range(65, 91)), 1), (b"#$%&*@^~<>{}[]\\=+_", 2), (b"!", 3), (b"|", 4),
    (b"0123456789", 5), (b".,;:'\"?()-/", 6), (b" \t\n\x0b\x0c\r", 7),
):
    _CLASS[list(_chars)] = _number
_rng = np.random.default_rng(7)
_PLACE = _rng.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per stretch of bytes, equal for equal stretches (all bytes outside count for the next one)."""
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    inside = place < np.repeat(ends - starts, np.diff(np.append(starts, len(data))))
    mixed = (data.astype(np.uint64) + np.uint64(1)) * _PLACE[place & 0xFFF] * (place.astype(np.uint64) // np.uint64(4096) * np.uint64(2) + np.uint64(1))
    return np.add.reduceat(np.where(inside, mixed, np.uint64(0)), starts)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines in order, bytes of each, number of lines of each text).

    Every text has a line at least: an empty text has an empty one.
    """
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "replace"), np.uint8)
    sizes = np.array([len(t.encode("utf-8", "replace")) + 1 for t in texts], np.int64)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc_ends = np.cumsum(sizes)
    doc = np.searchsorted(doc_ends, starts, "right")
    lines = np.bincount(doc, minlength=len(texts))
    length = (ends - starts).astype(np.float64)

    kind = _CLASS[data]
    each = [np.add.reduceat((kind == k).astype(np.int32), starts) for k in range(1, 8)]
    each[6] = each[6] - 1  # its own line end
    word = kind != 7
    begins = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    same = repeated = np.zeros(len(starts))
    words = np.zeros(len(starts))
    if len(begins):
        stops = np.flatnonzero(~word & np.concatenate([[False], word[:-1]]))
        lead = data.copy() if begins[0] == 0 else data[begins[0] :]
        shift = begins[0]
        h = _hashes(lead, begins - shift, stops - shift)
        line = np.searchsorted(ends, begins, "right")
        words = np.bincount(line, minlength=len(starts)).astype(float)
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (line[1:] == line[:-1])])
        same = np.bincount(line[again], minlength=len(starts))
        full = np.bincount(line, (h >> np.uint64(12)).astype(np.float64) * (1 + np.arange(len(h)) - np.searchsorted(line, line)), len(starts))
        _, inverse, count = np.unique(np.stack([doc.astype(float), full], 1), axis=0, return_inverse=True, return_counts=True)
        repeated = ((count[inverse.ravel()] > 1) & (words > 0)).astype(float)
    n = np.maximum(length, 1)
    w = np.maximum(words, 1)
    table = np.stack(
        [*(e / n for e in each), np.minimum(length / w, 30) / 10, same / w, repeated, np.log1p(length) / 5,
         (length > 400).astype(float), np.minimum(length / w, 60) / 60], 1,
    )
    return table, length + 1, lines
