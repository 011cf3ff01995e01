"""Queries over the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import line_dedup
from ..common import table


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.dedup(table(spark, sf_dir, "documents")))


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES = {
    "op6_line_dedup": r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
d as (select k.doc_id, k.pos, k.line, c.key is not null and k.doc_id <> c.keeper as gone from k left join c on k.key = c.key)
select doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from d group by doc_id
"""
}
