"""Lenient JSON and XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_list(x: Column) -> Column:
    """A JSON array of strings; null, empty and malformed texts give an empty one."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def encoded(x: Column) -> Column:
    """A value as JSON text; null lists and structs as null."""
    return F.to_json(x)


def recovered(x: Column, schema: str, needed: str) -> Column:
    """The object in a noisy text: inside a code fence, else between the outermost braces, else the last one that starts
    on a line of its own; null where none has the needed field."""
    tries = [F.regexp_extract(x, r"(?s)```[A-Za-z]*\s*(\{.*?\})\s*```", 1), F.regexp_extract(x, r"(?s)\{.*\}", 0), F.regexp_extract(x, r"(?s)(?:^|\n)\s*(\{[^\n]*\n?.*\})", 1), F.regexp_extract(x, r"(?s).*(\{[^{}]*\})", 1)]
    got = [F.from_json(t, schema) for t in tries]
    return F.coalesce(*[F.when(g[needed].isNotNull(), g) for g in got])


def envelope_rows(x: Column, error: str = "RESULT", rows: str = "row") -> Column:
    """The row objects (as maps) of a service's reply {service: [{head: ...}, {row: [...]}]}, whatever the service; none
    where the reply is an error."""
    # from_json of a map takes the first level whatever its keys; a chunk that isn't an array gives null
    chunks = F.flatten(F.map_values(F.map_filter(F.from_json(x, f"map<string,array<struct<{rows}:array<map<string,string>>>>>"), lambda _, v: v.isNotNull())))
    found = F.flatten(F.filter(F.transform(chunks, lambda c: c[rows]), lambda r: r.isNotNull()))
    return F.when(F.get_json_object(x, f"$.{error}").isNotNull() | found.isNull(), F.array().cast("array<map<string,string>>")).otherwise(found)


def one_or_many(x: Column) -> Column:
    """array<map<string,string>> of a JSON text that is one object or an array of them; none where it's neither."""
    t = F.trim(x)
    many = F.when(t.startswith("["), t).when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]")))
    return F.coalesce(F.filter(F.from_json(many, "array<map<string,string>>"), lambda m: m.isNotNull()), F.array().cast("array<map<string,string>>"))


def clean_list(xs: Column) -> Column:
    return F.filter(F.transform(xs, lambda s: F.trim(s)), lambda s: s != "")


def xml_rows(x: Column, row: str, fields: tuple[str, ...], error: str = "errorCode") -> Column:
    """The row elements of an XML text as structs, in order; none where the text has an error element."""
    blocks = F.regexp_extract_all(x, F.lit(rf"(?s)<{row}\b[^>]*>(.*?)</{row}>"), F.lit(1))
    value = lambda b, f: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(b, rf"(?s)<{f}\b[^>]*>(.*?)</{f}>", 1), r"<!\[CDATA\[|\]\]>", "")), F.lit(""))
    rows = F.transform(blocks, lambda b: F.struct(*[value(b, f).alias(f) for f in fields]))
    return F.when(x.contains(f"<{error}>"), F.slice(rows, 1, 0)).otherwise(rows)
