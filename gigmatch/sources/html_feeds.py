"""Listings in HTML pages and plain-text calendars."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gigmatch.functions.times import doors_show_times, infer_year_date, month_to_num, parse_full_date, rest_of, split_billing, unescape_html
from gigmatch.sources.json_feeds import clock, filled, raw_event

WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
MONTH_NAMES = "January|February|March|April|May|June|July|August|September|October|November|December"
STOP_LINES = ("home", "contact", "menu")


def _iso_date(start: Column) -> Column:
    """The date of ``2026-6-21T13:00-7:00`` and like forms."""
    part = lambda i: F.get(F.split(F.get(F.split(start, "T"), F.lit(0)), "-"), F.lit(i))
    return F.try_to_date(F.concat_ws("-", part(0), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")), "yyyy-MM-dd")


def _iso_clock(start: Column) -> Column:
    return clock(F.get(F.split(F.get(F.split(start, "T"), F.lit(1)), "[-+]"), F.lit(0)))


def extract_jsonld_events(pages: DataFrame, source: str, venue: str, fallback_url: str) -> DataFrame:
    """Shows from the JSON-LD scripts of pages (``html``); closed days are dropped."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    schema = "name string, startDate string, `@id` string, url string"
    rows = pages.select(F.explode(found).alias("s")).select(F.from_json("s", schema).alias("e"))
    rows = rows.select(F.trim("e.name").alias("title"), "e")
    rows = rows.filter(filled(F.col("title")) & ~F.upper("title").contains("CLOSED") & filled(F.col("e.startDate")))
    return rows.select(*raw_event(
        source=F.lit(source), source_id=F.coalesce(F.col("e.@id"), F.lit("")), headliner=F.trim(unescape_html(F.col("title"))),
        date=_iso_date(F.col("e.startDate")), show_time=_iso_clock(F.col("e.startDate")), venue=F.lit(venue),
        ticket_url=F.coalesce(F.col("e.url"), F.lit(fallback_url)),
    )).filter("date IS NOT NULL")


def extract_embedded_json_events(pages: DataFrame, attr: str, source: str, venue: str) -> DataFrame:
    """Shows from a JSON array held, escaped, in an attribute of pages (``html``)."""
    held = unescape_html(F.regexp_extract("html", rf'(?s){attr}="([^"]*)"', 1))
    schema = "array<struct<title: string, start: string, id: string, url: string>>"
    rows = pages.select(F.explode(F.from_json(held, schema)).alias("e")).select(F.trim("e.title").alias("title"), "e")
    rows = rows.filter(filled(F.col("title")) & ~F.upper("title").contains("CLOSED") & filled(F.col("e.start")))
    return rows.select(*raw_event(
        source=F.lit(source), source_id=F.coalesce(F.col("e.id"), F.lit("")), headliner=F.col("title"),
        date=_iso_date(F.col("e.start")), show_time=_iso_clock(F.col("e.start")), venue=F.lit(venue), ticket_url=F.col("e.url"),
    )).filter("date IS NOT NULL")


def _date_id(date: Column, headliner: Column) -> Column:
    return F.concat_ws("-", date.cast("string"), F.lower(F.replace(F.substring(headliner, 1, 10), F.lit(" "), F.lit(""))))


def carry_forward_date(lines: DataFrame, today: Column) -> DataFrame:
    """Lines (page_id, line_no, line) with the date line that stands over them: date, detail, and kind of the line.

    A date line opens a block, a stop line closes it; the last of either before a line decides.
    """
    text = F.trim("line")
    pattern = rf"(?i)^(?:{WEEKDAYS})\s+({MONTH_NAMES})\s+(\d{{1,2}})(?:\s*\(([^)]+)\))?$"
    month, day = month_to_num(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2).try_cast("int")
    kind = (
        F.when(text.rlike(pattern), "date")
        .when(F.lower(text).isin(*STOP_LINES), "stop")
        .when(text.rlike(rf"(?i)^(?:{WEEKDAYS})"), "other")
        .otherwise("text")
    )
    head = F.struct(infer_year_date(month, day, today).alias("date"), F.regexp_extract(text, pattern, 3).alias("detail"))
    marked = lines.filter(text != "").select("page_id", "line_no", text.alias("line"), kind.alias("kind"), head.alias("_head"))
    none = F.struct(F.lit(None).cast("date").alias("date"), F.lit("").alias("detail"))
    opening = F.when(F.col("kind") == "date", F.col("_head")).when(F.col("kind") == "stop", none)
    so_far = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.withColumn("_open", F.last(opening, ignorenulls=True).over(so_far))
    return carried.select("page_id", "line_no", "line", "kind", F.col("_open.date").alias("date"), F.col("_open.detail").alias("detail"))


def extract_listing_lines(lines: DataFrame, source: str, venue: str, url: str, today: Column) -> DataFrame:
    """Shows from a plain-text calendar: each line under a date is one show."""
    rows = carry_forward_date(lines, today).filter((F.col("kind") == "text") & F.col("date").isNotNull() & (F.lower("line") != "sold out"))
    names = F.transform(F.split("line", r"[-|]"), lambda n: F.trim(n))
    times = doors_show_times(F.col("detail"))
    rows = rows.select("date", names.alias("names"), times.alias("times"), F.get(names, F.lit(0)).alias("headliner")).filter("headliner <> ''")
    return rows.select(*raw_event(
        source=F.lit(source), source_id=_date_id(F.col("date"), F.col("headliner")), headliner=F.col("headliner"),
        openers=rest_of(F.col("names")), date=F.col("date"), doors_time=F.col("times.doors"), show_time=F.col("times.show"),
        venue=F.lit(venue), ticket_url=F.lit(url),
    ))


#: Phrases of weekly nights, and names that are no performers.
WEEKLY = ("every thursday", "every monday", "jam session")
NO_SHOW = "KARAOKE|BINGO"


def extract_paragraph_events(paragraphs: DataFrame, source: str, venue: str, url: str, today: Column) -> DataFrame:
    """Shows from paragraphs (``paragraph``): one each, named by its first line and dated by the first line with a date."""
    text = F.trim(F.replace("paragraph", F.lit("​"), F.lit("")))
    short = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    pattern = rf"(?i)(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\s*({short})[a-z]*\s*(\d{{1,2}})"
    dated = F.get(F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern)), F.lit(0))
    month, day = month_to_num(F.regexp_extract(dated, pattern, 1)), F.regexp_extract(dated, pattern, 2).try_cast("int")
    rows = paragraphs.select(text.alias("text"), infer_year_date(month, day, today).alias("date"))
    low = F.lower("text")
    weekly = F.lit(False)
    for phrase in WEEKLY:
        weekly = weekly | low.contains(phrase)
    lines = F.split("text", "\n")
    rows = rows.filter(F.col("date").isNotNull() & ~weekly).select("text", "date", F.trim(F.get(lines, F.lit(0))).alias("headliner"), lines.alias("lines"))
    rows = rows.filter((F.col("headliner") != "") & ~F.upper("headliner").rlike(NO_SHOW))
    guests = F.element_at(F.filter(rest_of(F.col("lines")), lambda x: F.lower(x).rlike("^(?:w/|with )")), -1)
    with_guests = F.filter(F.transform(F.split(F.regexp_replace(guests, "(?i)^(?:w/|with )", ""), "&"), lambda n: F.trim(n)), lambda n: n != "")
    has = F.exists(rest_of(F.col("lines")), lambda x: F.lower(x).rlike("^(?:w/|with )"))
    times = doors_show_times(F.col("text"))
    rows = rows.select("date", "headliner", F.when(has, with_guests).otherwise(F.array().cast("array<string>")).alias("openers"), times.alias("times"))
    return rows.select(*raw_event(
        source=F.lit(source), source_id=_date_id(F.col("date"), F.col("headliner")), headliner=F.col("headliner"), openers=F.col("openers"),
        date=F.col("date"), doors_time=F.col("times.doors"), show_time=F.col("times.show"), venue=F.lit(venue), ticket_url=F.lit(url),
    ))


@dataclass(frozen=True)
class Select:
    """An element by tag (any, if empty), by a class and by an attribute; ``take``: an attribute's value, else its text."""

    tag: str = ""
    cls: str = ""
    attr: str = ""
    value: str = ""
    take: str = ""


@dataclass(frozen=True)
class CardSpec:
    """How one family of pages shows its cards; ``venue`` is used where no element names one."""

    source: str
    row: Select
    title: Select
    date: Select
    link: Select
    time: Select | None = None
    venue_at: Select | None = None
    source_id: Select | None = None
    venue: str = ""


@dataclass
class _Node:
    tag: str
    attrs: dict
    parts: list = field(default_factory=list)

    def text(self) -> str:
        return " ".join(" ".join(p for p in self._parts() if isinstance(p, str)).split())

    def walk(self) -> Iterator["_Node"]:
        yield self
        yield from (p for p in self._parts() if not isinstance(p, str))

    def _parts(self) -> Iterator["_Node | str"]:
        """All that lies below, in document order, without recursion: elements left open may nest to any depth."""
        left = self.parts[::-1]
        while left:
            p = left.pop()
            yield p
            if not isinstance(p, str):
                left += p.parts[::-1]

    def fits(self, s: Select) -> bool:
        if s.tag and self.tag != s.tag or s.cls and s.cls not in (self.attrs.get("class") or "").split():
            return False
        return not s.attr or (s.attr in self.attrs if not s.value else self.attrs.get(s.attr) == s.value)

    def find(self, s: Select | None) -> str:
        hit = next((n for n in self.walk() if s and n.fits(s)), None)
        return "" if hit is None else ((hit.attrs.get(s.take) or "") if s.take else hit.text()).strip()


class _Tree(HTMLParser):
    VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs))
        self.open[-1].parts.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        del self.open[at or len(self.open) :]

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.open[-1].parts.append(data)


def cards(html: str, spec: CardSpec) -> list[tuple[str, str, str, str, str, str]]:
    """(source_id, title, date text, time text, venue, link) of each card of one page, once per source_id."""
    tree = _Tree()
    tree.feed(html or "")
    out, seen = [], set()
    for node in tree.root.walk():
        if not node.fits(spec.row):
            continue
        title, when, link = node.find(spec.title), node.find(spec.date), node.find(spec.link)
        key = node.find(spec.source_id) or (node.attrs.get(spec.row.take) or "" if spec.row.take else "") or link
        if title and when and link and key not in seen:
            seen.add(key)
            out.append((key, title, when, node.find(spec.time) or when, node.find(spec.venue_at) or spec.venue, link))
    return out


def extract_card_events(pages: DataFrame, spec: CardSpec, today: Column) -> DataFrame:
    """Shows from pages of cards (``html``).  Only cutting a page into cards runs in Python, one page at a time."""
    names = ["source_id", "title", "when", "time", "venue", "link"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([c for html in batch["html"] for c in cards(html, spec)], columns=names, dtype=object)

    found = pages.select("html").mapInPandas(run, ", ".join(f"{n} string" for n in names))
    date = F.coalesce(_iso_date(F.col("when")), parse_full_date(F.col("when"), today))
    rows = found.select("*", date.alias("date"), doors_show_times(F.col("time")).alias("times"), split_billing(F.col("title")).alias("bill"))
    return rows.filter("date IS NOT NULL").select(*raw_event(
        source=F.lit(spec.source), source_id=F.col("source_id"), headliner=F.col("bill.headliner"), openers=F.col("bill.openers"),
        date=F.col("date"), doors_time=F.col("times.doors"), show_time=F.coalesce(F.col("times.show"), _iso_clock(F.col("when"))),
        venue=F.col("venue"), ticket_url=F.col("link"),
    ))
