"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every matching text satisfies.
The index is stored by trigram: for each one that some query names, a posting list of the rows holding it, as bitmaps.
Intersecting and uniting posting lists gives each rule's candidates, and only candidates meet the expression itself.
A rule without a mandatory trigram is verified on every document.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmatch.llm.common import bitmaps, documents, has_bit, marked, materialise, with_rows

#: Strings that a part of an expression may stand for are listed up to this many, then the list starts anew.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``regex`` finds whole matches; those whose ``group`` has fewer than ``least`` characters are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds beyond the base ones: key files, web tokens, repository tokens.
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("repotoken", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + EXTRA


def _strings(item) -> set[str] | None:
    """All strings, in lower case, that one parsed item may stand for; None if they are too many."""
    kind, arg = item
    if kind is C.LITERAL:
        return {chr(arg).lower()}
    if kind is C.IN:
        out: set[str] = set()
        for what, value in arg:
            if what is C.LITERAL:
                out.add(chr(value).lower())
            elif what is C.RANGE and value[1] - value[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 6 else None
    if kind is C.MAX_REPEAT and arg[1] == 1:
        inner = _sequence(arg[2])
        return None if inner is None else inner | {""}
    if kind is C.SUBPATTERN:
        return _sequence(arg[3])
    if kind is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _any_of(strings: set[str]) -> set[frozenset[str]]:
    """Of alternatives, one must have all its trigrams; an alternative with none makes the condition empty."""
    options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return {o for o in options if not any(p < o for p in options)}


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """Conditions that all must hold; each is a list of trigram sets of which one must be present whole."""
    wanted: list[set[frozenset[str]]] = []
    run = {""}

    def close() -> None:
        nonlocal run
        options = _any_of(run)
        if frozenset() not in options:
            wanted.append(options)
        run = {""}

    for item in parser.parse(regex):
        more = _strings(item)
        kind, arg = item
        if more is None and kind is C.MAX_REPEAT and arg[0] > 0:
            close()  # at least one copy, but of unbounded length: what stands beside it isn't adjacent to a known string
        elif more is None or len(run) * len(more) > MOST_STRINGS:
            close()
            run = {""} if more is None else more
        else:
            run = {a + b for a, b in product(run, more)}
    close()
    return [sorted(c, key=sorted) for c in wanted]


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for c in trigram_query(r.regex) for o in c for t in o})


def trigram_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram number, _bucket, _bits) of ``rows`` (text, _row), stored in the order of the trigrams.

    They say which rows hold which of ``trigrams``, ASCII letters in either case.
    """
    lowered = rows.select("_row", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(i)) for i, t in enumerate(trigrams)]))
    postings = bitmaps(lowered.select("_row", F.explode(held).alias("trigram")), "secret-postings", ["trigram"])
    return materialise(postings.orderBy("trigram", "_bucket"), "secret-index")


def candidates(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """(_bucket, _rule_<i>): bitmaps of the rows whose postings satisfy the query of rule i.

    All trigrams of an option must be there, one option of each condition, and all conditions.
    """
    number = {t: i for i, t in enumerate(trigrams)}
    named = []
    for i, rule in enumerate(rules):
        query = trigram_query(rule.regex)
        for c, condition in enumerate(query):
            named += [(number[t], i, len(query), c, o, len(option)) for o, option in enumerate(condition) for t in option]
    spark = index.sparkSession
    wanted = spark.createDataFrame(named, "trigram int, rule int, conditions int, condition int, option int, whole int")
    found = index.join(F.broadcast(wanted), "trigram")  # a few hundred rows, from the rules alone
    count, every = F.count(F.lit(1)), lambda n: F.col("n") == F.col(n)
    options = found.groupBy("rule", "conditions", "condition", "option", "whole", "_bucket").agg(F.bitmap_and_agg("_bits").alias("_bits"), count.alias("n")).filter(every("whole"))
    met = options.groupBy("rule", "conditions", "condition", "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    both = met.groupBy("rule", "conditions", "_bucket").agg(F.bitmap_and_agg("_bits").alias("_bits"), count.alias("n")).filter(every("conditions"))
    return both.groupBy("_bucket").agg(*[F.max(F.when(F.col("rule") == i, F.col("_bits"))).alias(f"_rule_{i}") for i in range(len(rules))])


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Matches as (start, kind number, end), from the pieces between matches and the matches in order."""
    pairs = F.zip_with(
        F.split(text, rule.regex, -1),
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)).alias("m"),
            *([F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)).alias("g")] if rule.group else []),
        ),
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit["m"]).alias("n"), F.length(hit["g" if rule.group else "m"]).alias("g")),
    )
    kind = "array<struct<start:int,kind:int,end:int>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + p["gap"]
        end = start + F.coalesce(p["n"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        hit = F.coalesce(p["g"] >= F.lit(rule.least), F.lit(False))
        return F.struct(end.alias("at"), F.when(hit, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    return F.aggregate(pairs, empty, step, lambda s: s["out"])


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ","
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stored: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``found``, spans (start, kind, end) by start, then kind.

    Null text counts as empty; whole texts count, however long; positions are code points, ends exclusive.  Repeated
    rows and null ids are scanned row by row.  An empty table gives an empty result; further columns, whatever their
    names, are not read.  ``stored``: ``docs`` reads files and repeats no row of them; else a copy is written.  Texts
    are read twice where they lie, once for the index and once for verification, and never shuffled.
    """
    rows = with_rows(docs.select("doc_id", "text"), "secret-rows", stored)
    trigrams = vocabulary(rules)
    indexed = {i for i, r in enumerate(rules) if trigram_query(r.regex)}
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def verify(df: DataFrame) -> DataFrame:
        body = df.withColumn("_body", F.coalesce("text", F.lit("")))
        parts = []
        for i, rule in enumerate(rules):
            listed = has_bit(F.col(f"_rule_{i}"), F.col("_row")) if i in indexed else F.lit(True)
            parts.append(F.when(listed & F.col("_body").rlike(rule.regex), _spans(F.col("_body"), i, rule)).otherwise(none))
        return body.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))

    if not indexed:
        return verify(rows)
    near = materialise(candidates(trigram_index(rows, trigrams), rules, trigrams), "secret-candidates")
    return marked(rows, near, [f"_rule_{i}" for i in range(len(rules))], verify)


def op9_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), stored=True)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(_joined(base, RULES), 256).alias("base_sha256"),
        _joined(F.col("found"), RULES).alias("spans"),
    )


def _sql() -> str:
    def part(number: int, rule: Rule) -> str:
        regex = rule.regex.replace("'", "''")
        return f"""SELECT doc_id, {number} AS k, '{rule.kind}' AS kind, unnest(list_zip(
            string_split_regex(body, '{regex}'), regexp_extract_all(body, '{regex}', 0),
            regexp_extract_all(body, '{regex}', {rule.group}), range(len(string_split_regex(body, '{regex}'))))) AS p,
            {rule.least} AS least FROM d WHERE regexp_matches(body, '{regex}')"""

    parts = " UNION ALL ".join(part(i, r) for i, r in enumerate(RULES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
raw AS ({parts}),
ends AS (SELECT doc_id, k, kind, least, length(p[3]) AS g, p[4] AS i, length(p[2]) AS n,
    sum(length(p[1]) + coalesce(length(p[2]), 0)) OVER (PARTITION BY doc_id, k ORDER BY p[4]) AS stop FROM raw),
spans AS (SELECT doc_id, k, kind, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM ends WHERE g >= least)
SELECT d.doc_id, coalesce(s.n_assign, 0) AS n_assign, coalesce(s.n_access, 0) AS n_access,
    coalesce(s.n_hex, 0) AS n_hex, sha256(coalesce(s.base, '')) AS base_sha256, coalesce(s.spans, '') AS spans
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
    count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
    FROM spans GROUP BY doc_id) s USING (doc_id)
"""


SQL = _sql()
