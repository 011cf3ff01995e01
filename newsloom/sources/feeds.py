"""Feeds and lists that were fetched elsewhere, as rows: RSS, XML and JSON by built-in functions, HTML tables and links by
Arrow-batched functions of the standard library's parser. Fetching itself stays outside.

Every parser takes a DataFrame of documents (source, url, content) and returns one row per item; documents that can't be
read give none."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import jsonx
from ..functions.dates import parse_date, parse_period, status_of
from ..functions.python_udfs import unescape
from ..functions.text import collapsed, first_filled, without_tags

ITEM = "source string, url string, title string, agency string, notice_start date, notice_end date, body string"
CELLS = ArrayType(StructType([StructField("cells", ArrayType(StringType())), StructField("links", ArrayType(StringType()))]))
LINKS = ArrayType(StructType([StructField("href", StringType()), StructField("label", StringType())]))


def rss_items(docs: DataFrame, most: int = 20) -> DataFrame:
    """source, url, title, body, published of the first `most` items of each RSS text."""
    item = F.explode(F.slice(jsonx.xml_rows(F.col("content"), "item", ("title", "link", "description", "pubDate")), 1, most))
    rows = docs.select("source", item.alias("i"))
    text = lambda f: collapsed(without_tags(unescape(F.col(f"i.{f}"))))
    return rows.select("source", F.col("i.link").alias("url"), text("title").alias("title"), text("description").alias("body"), F.to_timestamp(F.try_to_timestamp(F.substring("i.pubDate", 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))).alias("published"))


def xml_notices(docs: DataFrame, row: str, fields: dict[str, str], link: str, most: int = 400) -> DataFrame:
    """Notices of an XML service: fields names the elements of title, agency, start, end and id; rows without an id go."""
    item = F.explode(F.slice(jsonx.xml_rows(F.col("content"), row, tuple(fields.values())), 1, most))
    rows = docs.select("source", item.alias("i"))
    get = lambda name: F.col(f"i.{fields[name]}")
    return rows.where(get("id").isNotNull()).select(
        "source", F.concat(F.lit(link), get("id")).alias("url"), collapsed(get("title")).alias("title"), get("agency").alias("agency"), parse_date(get("start")).alias("notice_start"), parse_date(get("end")).alias("notice_end")
    )


def json_bills(docs: DataFrame, envelope: str, aliases: dict[str, tuple[str, ...]], link: str) -> DataFrame:
    """Rows of a JSON service whose envelope holds an array of objects; each field is the first filled of its aliases."""
    found = F.from_json(F.get_json_object("content", f"$.{envelope}"), "array<map<string,string>>")
    rows = docs.select("source", F.explode(found).alias("r"))
    pick = lambda name: first_filled(*[F.col("r")[a] for a in aliases[name]])
    rows = rows.select("source", pick("id").alias("id"), pick("title").alias("title"), pick("agency").alias("agency"), parse_date(pick("end")).alias("notice_end"), pick("link").alias("link"))
    return rows.where("id is not null or link is not null").select("source", F.coalesce("link", F.concat(F.lit(link), "id")).alias("url"), "title", "agency", "notice_end")


class Page(HTMLParser):
    """Table rows as cell texts and links, and all links with their labels."""

    def __init__(self, content: str):
        super().__init__(convert_charrefs=True)
        self.rows, self.links, self._cell, self._label, self._skip = [], [], None, None, 0
        self.feed(content)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        href = dict(attrs).get("href")
        if tag in ("script", "style"):
            self._skip += 1
        elif tag == "tr":
            self.rows.append(([], []))
        elif tag in ("td", "th") and self.rows:
            self._cell = []
            self.rows[-1][0].append(self._cell)
        elif tag == "a" and href:
            self._label = []
            self.links.append((href, self._label))
            if self._cell is not None:
                self.rows[-1][1].append(href)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self._skip = max(0, self._skip - 1)
        elif tag in ("td", "th", "tr"):
            self._cell = None
        elif tag == "a":
            self._label = None

    def handle_data(self, data: str) -> None:
        if not self._skip:
            for into in (self._cell, self._label):
                if into is not None:
                    into.append(data)


def _text(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


@F.pandas_udf(CELLS)
def table_rows(content: pd.Series) -> pd.Series:
    """The rows of all tables, with cells and links."""
    return content.map(lambda c: [{"cells": [_text(x) for x in cells], "links": links} for cells, links in Page(c).rows], na_action="ignore")


@F.pandas_udf(LINKS)
def page_links(content: pd.Series) -> pd.Series:
    return content.map(lambda c: [{"href": h, "label": _text(x)} for h, x in Page(c).links], na_action="ignore")


def html_notices(docs: DataFrame, link: str, base: str, agency: int, period: int, title: int = 1) -> DataFrame:
    """Notices of HTML tables: rows with a link that matches the pattern, whose first group is the notice's number.
    agency, period and title are cell positions; an agency loses the bracket at its end."""
    rows = docs.select("source", F.explode(table_rows("content")).alias("r"))
    href = F.get(F.filter("r.links", lambda x: x.rlike(link)), F.lit(0))
    cell = lambda k: F.coalesce(F.get("r.cells", F.lit(k)), F.lit(""))
    rows = rows.withColumn("href", href).where("href is not null").withColumn("p", parse_period(cell(period)))
    return rows.select(
        "source", F.concat(F.lit(base), F.regexp_extract("href", link, 1)).alias("url"), cell(title).alias("title"), F.regexp_replace(cell(agency), r"\s*\([^)]*\)\s*$", "").alias("agency"), F.col("p.start").alias("notice_start"), F.col("p.end").alias("notice_end")
    )


def article_links(docs: DataFrame, link: str, label_most: int = 24) -> DataFrame:
    """Distinct links of index pages that match the pattern, in order of appearance, with the first label that isn't
    empty and not too long."""
    rows = docs.select("source", F.posexplode(page_links("content")).alias("seq", "l")).where(F.col("l.href").rlike(link))
    short = F.when((F.col("l.label") != "") & (F.char_length("l.label") <= label_most), F.col("seq"))
    return rows.groupBy("source", F.col("l.href").alias("url")).agg(F.min("seq").alias("seq"), F.min_by("l.label", short).alias("label"))


def all_sources(sources: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame | None, list[str]]:
    """The union of all sources that can be planned, and the labels of those that can't; one that fails stops no other."""
    out, failed = None, []
    for label, make in sources:
        try:
            rows = make().withColumn("label", F.lit(label))
            rows.schema  # noqa: B018  plans it
        except Exception:  # noqa: BLE001  whatever a source raises
            failed.append(label)
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, failed


def without_boilerplate(body: Column, heading: str, phrases: tuple[str, ...] = (), after: int = 30, most: int = 8000) -> Column:
    """A body from its heading on, where that stands after the first `after` characters, without navigation phrases."""
    for phrase in phrases:
        body = F.replace(body, F.lit(phrase), F.lit(" "))
    at = F.regexp_instr(body, F.lit(heading))
    return F.substring(collapsed(F.when(at > after, F.substr(body, at)).otherwise(body)), 1, most)


def until_short(rows: DataFrame, page_rows: int) -> DataFrame:
    """Rows (source, page, ...) of a source's pages up to the first that holds fewer than `page_rows`: what comes after it
    was asked for in vain, or is an old copy."""
    short = rows.groupBy("source", "page").agg(F.count("*").alias("n")).where(F.col("n") < page_rows).groupBy("source").agg(F.min("page").alias("last"))
    return rows.join(short, "source", "left").where(F.col("last").isNull() | (F.col("page") <= F.col("last"))).drop("last")


def paged_notices(docs: DataFrame, link: str, base: str, agency: int, period: int, today, title: int = 1, page_rows: int = 10) -> DataFrame:
    """html_notices() of list pages (source, page, content), with the page, without query strings in links, with status by
    the end of the period, and up to the first short page of a source."""
    paged = docs.select(F.struct("source", "page").alias("source"), "content")
    rows = html_notices(paged, link, base, agency, period, title)
    rows = rows.select("source.source", "source.page", F.regexp_replace("url", r"\?.*$", "").alias("url"), "title", "agency", "notice_start", "notice_end", status_of(F.col("notice_end"), today).alias("status"))
    return until_short(rows, page_rows)


def trade_news(docs: DataFrame, link: str, agency: str, relevance: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """News of a JSON service {response: {header: {resultCode}, body: {itemList: {item: ...}}}}, where item is one object
    or a list, and itemList may be the list itself; replies with another code than 0 or 00 give none. relevance gets
    industry, information class and title. The title names the nation; the body is made of what the service tells."""
    at = lambda path: F.get_json_object("content", f"$.response.{path}")
    found = F.coalesce(at("body.itemList.item"), at("body.itemList"))
    rows = docs.where(at("header.resultCode").isin("0", "00")).select("source", F.explode(jsonx.one_or_many(found)).alias("r"))
    get = lambda name: F.trim(F.coalesce(F.col("r")[name], F.lit("")))
    title = collapsed(unescape(get("title")))
    rows = rows.select("source", title.alias("name"), get("nation").alias("nation"), get("industry").alias("industry"), get("info").alias("info"), get("office").alias("office"), get("id").alias("id"), get("url").alias("given"), parse_period(get("published"))["start"].alias("notice_start"))
    rows = rows.withColumn("url", F.coalesce(F.nullif("given", F.lit("")), F.when(F.col("id") != "", F.concat(F.lit(link), "id"))))
    rows = rows.where((F.col("name") != "") & F.col("url").isNotNull() & relevance(F.col("industry"), F.col("info"), F.col("name")))
    named = F.when((F.col("nation") != "") & ~F.contains("name", F.col("nation")), F.concat(F.lit("["), "nation", F.lit("] "), "name")).otherwise(F.col("name"))
    where = F.when((F.col("nation") != "") | (F.col("industry") != ""), F.concat(F.lit("("), "nation", F.lit(" · "), "industry", F.lit(")")))
    body = F.concat_ws(" ", "name", where, F.nullif(F.concat_ws(" · ", F.nullif("office", F.lit("")), F.nullif("info", F.lit(""))), F.lit("")))
    return rows.select("source", "url", named.alias("title"), F.lit(agency).alias("agency"), "notice_start", body.alias("body"))


def json_grants(docs: DataFrame, rows: str, link: str, agency: str) -> DataFrame:
    """Calls of a JSON list with paging: source, url, title, agency, department, notice_start, notice_end, body, and
    last_page. A deadline in the list makes the page unneeded: detail_needed tells."""
    found = docs.select("source", F.explode(jsonx.one_or_many(F.get_json_object("content", f"$.{rows}"))).alias("r"), F.coalesce(F.get_json_object("content", "$.paging.page").try_cast("int") >= F.get_json_object("content", "$.paging.pages").try_cast("int"), F.lit(True)).alias("last_page"))
    get = lambda name: collapsed(F.coalesce(F.col("r")[name], F.lit("")))
    start, end = F.coalesce(parse_date(get("opens")), parse_date(get("announced"))), parse_date(get("closes"))
    period = F.concat(F.coalesce(start.cast("string"), F.lit("?")), F.lit(" ~ "), F.coalesce(end.cast("string"), F.lit("?")))
    return found.where(get("id") != "").select("source", F.concat(F.lit(link), get("id")).alias("url"), get("title").alias("title"), F.coalesce(F.nullif(get("agency"), F.lit("")), F.lit(agency)).alias("agency"), get("office").alias("department"), start.alias("notice_start"), end.alias("notice_end"), F.concat_ws(" · ", get("title"), get("office"), period).alias("body"), end.isNull().alias("detail_needed"), "last_page")
