"""Queries over raw web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import warc
from ..common import table


def op9_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {"op9_warc_zstd": op9_warc_zstd}
ORACLES = {
    "op9_warc_zstd": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha256(b) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when f.first is null or d.page_id = f.first then 'response' else 'revisit' end as record_type,
       case when d.page_id <> f.first then f.first end as refers_to
from d left join f on d.payload_digest = f.payload_digest
"""
}
