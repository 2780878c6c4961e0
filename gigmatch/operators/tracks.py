"""Candidate tracks of a catalogue for requested ones, by blocks of rare tokens.

A track's tokens are the words of its performer and of its title, and the first and last characters of both, which
outlast a slip in the only word; a name without Latin letters gives pairs of its characters instead.  A token that few tracks have is a block of its own; frequent tokens make blocks in pairs only, so
no block is as large as the most frequent word.  A request looks into its RAREST blocks and that of its performer's
whole name, and keeps the tracks with which it shares most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gigmatch.functions.names import normalize_name
from gigmatch.sources.shared import bounded, materialise

#: Tracks of a token from which on it is frequent, blocks that a request looks into, and tracks that it keeps.
FREQUENT, RAREST, KEPT = 500, 6, 20
#: Characters of a name's end that make a token.
END = 4


def plain_form(name: Column) -> Column:
    """The normal form of a name; of one without Latin letters and digits its own text in lower case."""
    norm, raw = normalize_name(name), F.trim(F.lower(name))
    return F.when(norm != "", norm).otherwise(raw)


def _tokens(name: Column, mark: str) -> Column:
    norm, raw = normalize_name(name), F.regexp_replace(F.lower(name), r"\s+", "")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw) - 1, F.lit(1))), lambda i: F.substring(raw, i, F.lit(2)))
    ends = [F.concat(F.lit("^"), F.substring(raw, 1, END)), F.concat(F.lit("$"), F.reverse(F.substring(F.reverse(raw), 1, END)))]
    words = F.when(norm != "", F.concat(F.split(norm, " "), F.array(*ends))).when(raw != "", pairs).otherwise(F.array().cast("array<string>"))
    return F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit(mark), w))


def _blocks(tokens: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, block) from (id, token): rare tokens, and pairs of frequent ones."""
    marked = tokens.join(frequent, F.col("token") == F.col("hot"), "left")
    both = F.collect_set(F.when(F.col("hot").isNotNull(), F.col("token")))
    hot = marked.groupBy("id").agg(F.array_sort(both).alias("h"))
    pairs = F.flatten(F.transform("h", lambda a: F.transform(F.filter("h", lambda b: b > a), lambda b: F.concat_ws("|", a, b))))
    return marked.filter("hot is null").select("id", F.col("token").alias("block")).unionByName(hot.select("id", F.explode(pairs).alias("block")))


def track_candidates(requests: DataFrame, catalog: DataFrame, rarest: int = RAREST, kept: int = KEPT, many: int = FREQUENT) -> DataFrame:
    """(artist_name, track_name, uri, name, artists): each request with up to ``kept`` tracks that share most of its tokens.

    Tracks whose performer has the same form are among them before others.
    """
    with_tokens = lambda df, a, t: df.withColumn("form", plain_form(F.col(a))).withColumn("tokens", F.array_distinct(F.concat(_tokens(F.col(a), "a:"), _tokens(F.col(t), "t:"))))
    number = F.monotonically_increasing_id().alias("id")
    asked = materialise(with_tokens(requests.select("artist_name", "track_name").distinct(), "artist_name", "track_name").select(number, "*"), "tracks-asked")
    there = materialise(with_tokens(catalog.select("uri", "name", "artists"), "artists", "name").select(number, "*"), "tracks-there")
    left, right = (t.select("id", F.explode("tokens").alias("token")) for t in (asked, there))
    # Tokens that no request has make no blocks.
    some = materialise(left.select(F.col("token").alias("some")).distinct(), "tracks-some")
    right = right.join(bounded(some), F.col("token") == F.col("some"), "left_semi")
    counts = right.groupBy(F.col("token").alias("hot")).agg(F.count(F.lit(1)).alias("n"))
    frequent = materialise(counts.filter(F.col("n") > many).select("hot"), "tracks-frequent")

    known = materialise(_blocks(right, frequent), "tracks-blocks")
    sizes = known.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("id").orderBy("size", "block")
    wanted = _blocks(left, frequent).join(sizes, "block").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rarest)
    near = wanted.select("id", "block").join(known.select(F.col("id").alias("other"), "block"), "block").select("id", "other")
    same = asked.filter("form <> ''").select("id", "form").join(there.filter("form <> ''").select(F.col("id").alias("other"), "form"), "form").select("id", "other")
    shared = near.withColumn("own", F.lit(0)).unionByName(same.withColumn("own", F.lit(1))).groupBy("id", "other").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    rows = shared.join(asked.select("id", "artist_name", "track_name", F.col("tokens").alias("mine")), "id").join(there.select(F.col("id").alias("other"), "uri", "name", "artists", "tokens"), "other")
    alike = F.size(F.array_intersect("mine", "tokens")) / F.sqrt(F.greatest(F.size("mine") * F.size("tokens"), F.lit(1)))
    best = Window.partitionBy("artist_name", "track_name").orderBy(F.desc("own"), F.desc("alike"), "uri")
    # Tracks of the performer aren't cut off by ``kept``: they are as many as a performer has.
    ranked = rows.withColumn("alike", alike).withColumn("place", F.row_number().over(best))
    return ranked.filter((F.col("place") <= kept) | (F.col("own") == 1)).select("artist_name", "track_name", "uri", "name", "artists")
