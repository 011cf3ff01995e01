"""Queries of documents against the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import decontaminate
from ..common import table


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {
    "op4_decontaminate": r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') as k
        from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as p from iw where len(w) > 0)),
sizes as (select distinct n from win),
occ as (select d.doc_id, d.p, d.n, win.item_id
        from (select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as k
              from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from dw, sizes where len(w) >= n)) d
        join win on win.n = d.n and win.k = d.k),
hit as (select doc_id, count(distinct q) as n_hit from (select distinct doc_id, unnest(range(p, p + n)) as q from occ) group by 1),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, item_id, item_id::varchar as i from occ) group by 1)
select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hit on dw.doc_id = hit.doc_id left join its on dw.doc_id = its.doc_id
"""
}
