"""Phrase collocations from FM-indexes over word ids, one per shard, whose counts are summed.

A shard holds about SHARD words of one language.  Its index is the order of the suffixes of its words and of those of
their reverse, each with the word before every suffix (the Burrows-Wheeler transform) and the map from a suffix to the
one that begins a word earlier.  An n-gram is an interval in both orders; one pass over the words before (after) the
suffixes of all intervals gives every extension to the left (right), its count and its two intervals.

Words that are too rare to be in any phrase are known before bigrams are counted, and bigrams before longer phrases:
a shard gets back which of its own words and bigrams are frequent in the corpus, from a table while that is small and
else by a join on the shard, and extends over those alone.  Nothing frequent is lost by that, since a phrase is at most as frequent as its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gigmatch.llm.common import documents, global_rank, materialise
from gigmatch.llm.workers import lean

#: Fewest occurrences of a phrase, most words in one, and how many phrases of a language are reported.
LEAST, LONGEST, FIRST = 100, 5, 2000
#: Words of a shard, about; a document is never cut.
SHARD = 1 << 20
#: Frequent words and bigrams that every task may hold, counts that a task holds, and words of a bucket of counts.
WORDS, PAIRS, HELD, BUCKET = 1 << 18, 1 << 20, 1 << 20, 1 << 22
#: Fixed value: characters that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
_MARK = b"\xff"  # in no UTF-8 text
_TABLE = bytes.maketrans(ENDS, _MARK * len(ENDS))


def piece_words(text: str) -> list[bytes]:
    """A text's words, A-Z lowered, with a mark at each end of a piece."""
    return text.encode("utf-8", "replace").lower().translate(_TABLE).replace(_MARK, b" " + _MARK + b" ").split()


def _planes(values: np.ndarray) -> bytes:
    """Numbers by bytes of equal weight, which compress well when they are sorted or small."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _from_planes(data: bytes, kind: str, width: int = 1) -> np.ndarray:
    """Rows of ``width`` numbers from ``_planes``."""
    size = np.dtype(kind).itemsize * width
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1, width)


def packed(ids: np.ndarray) -> bytes:
    """Ids below 2^31 by bytes of equal weight, which compress well."""
    return _planes(ids.astype("<u4"))


def unpacked(data: bytes) -> np.ndarray:
    return _from_planes(data, "<u4")[:, 0].astype(np.int64)


class _Shard:
    """Words of one language: local ids from 1 in order of appearance, 0 between pieces."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {_MARK: 0}
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        number = self.numbers
        for w in set(words).difference(number):
            number[w] = len(number)
        got = np.array([*map(number.__getitem__, words), 0], np.int64)
        self.ids.append(got)
        self.size += len(got)

    def row(self, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        counts = np.bincount(ids, minlength=len(self.numbers))[1:]
        names = [w.decode("utf-8") for w in list(self.numbers)[1:]]
        columns = [pa.array([lang]), pa.array([packed(ids)]), pa.array([names], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "ids", "words", "counts"])


def make_shards(docs: DataFrame, size: int) -> DataFrame:
    """shard, lang, ids, words (from id 1 on) and their counts, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Shard] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                open_.setdefault(lang, _Shard()).add(piece_words(text))
                if sum(s.size for s in open_.values()) >= size:
                    full = max(open_, key=lambda k: open_[k].size)
                    yield open_.pop(full).row(full)
        for lang, shard in open_.items():
            yield shard.row(lang)

    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = read.mapInArrow(lean(run), "lang string, ids binary, words array<string>, counts array<long>")
    return materialise(made.select(F.monotonically_increasing_id().alias("shard"), "*"), "phrases-shards")


class Index:
    """Suffixes of ``ids`` and of their reverse, in order of their first ``depth`` words at least."""

    def __init__(self, ids: np.ndarray, depth: int) -> None:
        self.ids = ids
        self.sides = [self._side(ids, depth), self._side(ids[::-1], depth)]
        bounds = np.flatnonzero(np.diff(np.sort(ids), prepend=-1))
        self.firsts, self.starts = np.sort(ids)[bounds], bounds
        self.sizes = np.diff(bounds, append=len(ids))

    @staticmethod
    def _side(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """By suffix: the id before it, and the place in the order of the suffix that begins there."""
        rank, width = ids, 1
        order = np.argsort(rank, kind="stable")
        while width < depth:
            after = np.zeros_like(rank)
            after[:-width] = rank[width:] + 1
            key = rank << 32 | after
            order = np.argsort(key, kind="stable")
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
            width *= 2
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        return np.where(order > 0, ids[order - 1], 0), place[order - 1]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every word as a phrase: (ids, intervals' starts in both orders, counts)."""
        real = self.firsts > 0
        return self.firsts[real][:, None], np.stack([self.starts[real]] * 2), self.sizes[real]

    def extend(self, phrases: np.ndarray, starts: np.ndarray, counts: np.ndarray, side: int, allowed: np.ndarray | None):
        """All phrases one word longer, to the left (``side`` 0) or right (1), in the form of ``words``.

        ``allowed``: sorted pairs (first word << 32 | second word) that may meet there; None: all.
        """
        before, place = self.sides[side]
        owner = np.repeat(np.arange(len(counts)), counts)
        ends = np.cumsum(counts)
        rows = np.arange(len(owner)) - np.repeat(ends - counts, counts) + np.repeat(starts[side], counts)
        key = owner << 32 | before[rows]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(first, append=len(key))
        own, word = key[first] >> 32, key[first] & 0xFFFFFFFF
        good = word > 0
        if allowed is not None:
            pair = word << 32 | phrases[own, 0] if side == 0 else phrases[own, -1] << 32 | word
            at = np.minimum(np.searchsorted(allowed, pair), max(len(allowed) - 1, 0))
            good &= allowed[at] == pair if len(allowed) else False
        # Suffixes alike in their first ``depth`` words may lie in another order there, but in the same interval.
        lowest = np.minimum.reduceat(place[rows], first) if len(first) else first
        first, n, own, word, lowest = (x[good] for x in (first, n, own, word, lowest))
        moved = np.empty((2, len(first)), np.int64)
        moved[side] = lowest
        moved[1 - side] = starts[1 - side][own] + first - (ends - counts)[own]
        longer = [word[:, None], phrases[own]] if side == 0 else [phrases[own], word[:, None]]
        return np.concatenate(longer, 1), moved, n


def _summed(phrases: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their counts."""
    if not len(phrases):
        return phrases, counts
    order = np.lexsort(phrases.T[::-1])
    phrases, counts = phrases[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (phrases[1:] != phrases[:-1]).any(1)]))
    return phrases[first], np.add.reduceat(counts, first)


class _Counts:
    """Counts of phrases of several shards, summed before they are shuffled, dealt into buckets by a hash."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.held, self.size = buckets, {}, 0

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        self.held.setdefault(phrases.shape[1], []).append((phrases.astype("<u4"), counts))
        self.size += len(counts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for m, parts in self.held.items():
            phrases, counts = _summed(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]))
            mixed = np.zeros(len(counts), np.uint64)
            for column in phrases.T:
                mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            bucket = (mixed % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(own):
                    columns = [[m], [int(bucket[own[0]])], [_planes(phrases[own])], [_planes(counts[own].astype("<i8"))]]
                    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["m", "bucket", "phrases", "counts"])
        self.held, self.size = {}, 0


_COUNTS = "m int, bucket long, phrases binary, counts binary"


def _over_shards(ids_of: Callable[[pa.RecordBatch, int], np.ndarray], buckets: int, each: Callable):
    """``each`` of every shard's ids, adding to counts that are given out whenever enough are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(buckets)
        for batch in batches:
            for i in range(batch.num_rows):
                each(ids_of(batch, i), batch, i, counts)
                if counts.size > HELD:
                    yield from counts.rows()
        yield from counts.rows()

    return run


def _by_table(words):
    """Corpus-wide ids of a shard's local ones, by a table of all frequent words."""

    def ids_of(batch: pa.RecordBatch, i: int) -> np.ndarray:
        table = words.value
        table = table.filter(pc.equal(table.column("lang"), batch.column("lang")[i]))
        at = pc.index_in(batch.column("words")[i].values, table.column("word").combine_chunks())
        numbers = np.concatenate([[0], table.column("id").to_numpy()])
        own = np.concatenate([[0], numbers[pc.fill_null(pc.add(at, 1), 0).to_numpy()]])
        return _squeezed(own[unpacked(batch.column("ids")[i].as_py())])

    return ids_of


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """One mark between pieces is enough, for rare words as well."""
    return ids[np.concatenate([[True], (ids[1:] > 0) | (ids[:-1] > 0)])] if len(ids) else ids


def _stored_ids(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return unpacked(batch.column("ids")[i].as_py())


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with corpus-wide ids, from those with a list of (local id, id)."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = unpacked(batch.column("ids")[i].as_py())
            known = batch.column("known")[i].values.flatten()
            own = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
            own[known[0].to_numpy()] = known[1].to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), pa.array([packed(_squeezed(own[ids]))])], ["shard", "ids"])


def _pairs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index = Index(ids, 2)
    phrases, _, n = index.extend(*index.words(), 0, None)
    return phrases, n


def _count_pairs(ids: np.ndarray, batch: pa.RecordBatch, i: int, counts: _Counts) -> None:
    counts.add(*_pairs_of(ids))


def _list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            phrases, _ = _pairs_of(_stored_ids(batch, i))
            pairs = pa.array([phrases[:, 0] << 32 | phrases[:, 1]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), pairs], ["shard", "pairs"])


def _count_longer(longest: int, frequent=None) -> Callable:
    """Counts phrases of three words and more, all of whose bigrams are frequent in the corpus."""

    def each(ids: np.ndarray, batch: pa.RecordBatch, i: int, counts: _Counts) -> None:
        allowed = frequent.value if frequent is not None else np.sort(batch.column("frequent")[i].values.to_numpy())
        index = Index(ids, longest)
        found = index.extend(*index.words(), 0, allowed)
        for m in range(3, longest + 1):
            found = index.extend(*found, m % 2, allowed)
            if not len(found[2]):
                break
            counts.add(found[0], found[2])

    return each


def _frequent(least: int):
    """Sums the counts of a bucket; gives the keys of ``least`` occurrences or more."""

    def run(group: pa.Table) -> pa.Table:
        m = group.column("m")[0].as_py()
        phrases = np.concatenate([_from_planes(x, "<u4", m) for x in group.column("phrases").to_pylist()])
        counts = np.concatenate([_from_planes(x, "<i8")[:, 0] for x in group.column("counts").to_pylist()])
        phrases, counts = _summed(phrases, counts)
        on = counts >= least
        offsets = np.arange(int(on.sum()) + 1, dtype=np.int32) * (4 * m)
        keys = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(phrases[on].astype(">u4").tobytes())])
        return pa.table({"key": keys, "f": pa.array(counts[on])})

    return run


def _key(number: Column, size: int) -> Column:
    """The big-endian bytes of a number."""
    return F.unhex(F.lpad(F.hex(number), 2 * size, "0"))


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD, table_words: int = WORDS, table_pairs: int = PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Languages (lang, n), words (lang, word, id, key, f) and phrases (key, m, f), both of ``least`` occurrences or more.

    A key is the ids of a phrase's words, four bytes each; an id belongs to a word of one language.  Frequent words and
    bigrams go to every task if there are no more of them than ``table_words`` and ``table_pairs``; beyond that every
    shard gets its own by a join, with the same counts.
    """
    spark = docs.sparkSession
    shards = make_shards(docs, size)
    each = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    counted = materialise(each.groupBy("lang", "word").agg(F.sum("c").alias("f")), "phrases-words")
    langs = materialise(counted.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-langs")
    ranked = global_rank(counted.filter(F.col("f") >= least), ["lang", "word"], "phrases-ranks")
    number = F.when(F.col("_rank") < (1 << 31) - 2, F.col("_rank") + 1).otherwise(F.raise_error(F.lit("more than 2^31 frequent words")))
    words = materialise(ranked.select("lang", "word", number.alias("id"), _key(number, 4).alias("key"), "f"), "phrases-frequent")

    total = langs.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET, 1)
    few = words.count() <= table_words
    if few:  # every task gets the table of frequent words
        known = spark.sparkContext.broadcast(words.select("lang", "word", "id").toArrow())
        coded, ids_of = shards.select("lang", "ids", "words"), _by_table(known)
    else:  # every shard gets its own words
        numbers = words.select(F.col("lang").alias("l"), F.col("word").alias("w"), "id")
        local = shards.select("shard", "lang", F.posexplode("words").alias("at", "word"))
        own = local.join(numbers, (F.col("lang") == F.col("l")) & (F.col("word") == F.col("w")))
        own = own.groupBy("shard").agg(F.collect_list(F.struct((F.col("at") + 1).cast("long").alias("at"), "id")).alias("known"))
        coded = materialise(shards.select("shard", "ids").join(own, "shard").mapInArrow(lean(_numbered), "shard long, ids binary"), "phrases-coded")
        ids_of = _stored_ids

    def summed(rows: DataFrame, each: Callable) -> DataFrame:
        counted = rows.mapInArrow(lean(_over_shards(ids_of, buckets, each)), _COUNTS)
        return counted.groupBy("m", "bucket").applyInArrow(_frequent(least), "key binary, f long")

    two = materialise(summed(coded, _count_pairs), "phrases-pairs")
    pair = F.conv(F.hex("key"), 16, 10).cast("long")
    if few and two.count() <= table_pairs:
        allowed = spark.sparkContext.broadcast(np.sort(two.select(pair.alias("pair")).toArrow().column("pair").to_numpy()))
        more = summed(coded, _count_longer(longest, allowed))
    else:
        if few:
            coded, ids_of = materialise(_with_shard(shards, known), "phrases-coded"), _stored_ids
        pairs = coded.mapInArrow(lean(_list_pairs), "shard long, pairs array<long>").select("shard", F.explode("pairs").alias("pair"))
        frequent = pairs.join(two.select(pair.alias("p")), F.col("pair") == F.col("p"), "left_semi")
        frequent = frequent.groupBy("shard").agg(F.collect_list("pair").alias("frequent"))
        more = summed(coded.join(frequent, "shard").select("ids", "frequent"), _count_longer(longest))
    phrases = two.unionByName(more)
    return langs, words, materialise(phrases.select("key", F.expr("length(key) div 4").cast("int").alias("m"), "f"), "phrases-counts")


def _with_shard(shards: DataFrame, words) -> DataFrame:
    """(shard, ids) with corpus-wide ids."""
    ids_of = _by_table(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), pa.array([packed(ids_of(batch, i))])], ["shard", "ids"])

    return shards.select("shard", "lang", "ids", "words").mapInArrow(lean(run), "shard long, ids binary")


def _whole(a: Column, b: Column) -> Column:
    """floor(a / b) of non-negative whole decimals, without rounding."""
    return ((a - a % b) / b).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, size: int = SHARD, table_words: int = WORDS, table_pairs: int = PAIRS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``first`` best phrases of two to ``longest`` words.

    Words are stretches without space and tab in pieces between sentence marks and line ends, A-Z lowered; a null
    language is ``und``, null and empty texts have no words.  A phrase's score is 1000 a n / (l r), floored, of its
    lowest cut, at the first one of equals; phrases as frequent as a longer one that holds them go.  Equal scores are
    ordered by count, then by the phrase's bytes.  Rows that repeat or have null ids count each; whole texts count;
    an empty table gives an empty result; further columns, whatever their names, are not read.
    """
    langs, words, phrases = phrase_counts(docs, least, longest, size, table_words, table_pairs)
    long = phrases.filter("m > 2")
    parts = long.select(F.expr("substring(key, 1, 4 * (m - 1))").alias("part"), "f").unionByName(long.select(F.expr("substring(key, 5)").alias("part"), "f"))
    longer = parts.groupBy("part").agg(F.max("f").alias("most"))
    kept = phrases.join(longer, F.col("key") == F.col("part"), "left").filter("most is null or most < f").select("key", "m", F.col("f").alias("a"))

    by_word = words.join(langs.select(F.col("lang").alias("l"), "n"), F.col("lang") == F.col("l")).select(F.col("key").alias("begin"), "lang", "n")
    kept = kept.join(by_word, F.expr("substring(key, 1, 4)") == F.col("begin")).select("key", "lang", "n", "a", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
    known = words.select("key", "f").unionByName(phrases.select("key", "f"))
    left, right = (known.select(F.col("key").alias(f"{side}_key"), F.col("f").alias(side)) for side in ("l", "r"))
    cut = kept.join(left, F.expr("substring(key, 1, 4 * k)") == F.col("l_key")).join(right, F.expr("substring(key, 4 * k + 1)") == F.col("r_key"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = _whole((wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))
    best = cut.select("key", "lang", "n", "a", F.struct(score.alias("score"), "k", "l", "r").alias("x")).groupBy("key", "lang", "n", "a").agg(F.min("x").alias("x"))
    scored = materialise(best.select("key", "lang", "n", "a", "x.score", "x.l", "x.r"), "phrases-scores")

    # Top of each language in two steps: no task takes all phrases of one.
    order = [F.desc("score"), F.desc("a")]
    deals = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = scored.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(deals)))
    for by in (["lang", "deal"], ["lang"]):
        dealt = dealt.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= first)
    top = materialise(dealt.drop("place", "deal"), "phrases-top")
    at = top.select(F.col("key").alias("k"), F.posexplode(F.expr("transform(sequence(1, length(key) div 4), i -> substring(key, cast(4 * i - 3 as int), 4))")).alias("at", "one"))
    spelt = at.join(words.select(F.col("key").alias("w"), "word"), F.col("one") == F.col("w")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x"))
    named = top.join(spelt, F.col("key") == F.col("k")).withColumn("phrase", F.concat_ws(" ", F.col("x.word")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return named.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_fm_index_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT * FROM counts WHERE m > 1),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.m > c.m AND 100 * d.f >= 100 * c.f
      AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM kept, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scores)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE cut = 1)
WHERE rank <= 2000
"""
