"""Queries over the words of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import spelling
from ..common import table


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: crc32 in SQL: the table of the reversed polynomial, by its rule, and bytes taken one after another.
CRC = """
steps as (select i, 0 as k, i::bigint as c from range(256) t(i)
          union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end from steps where k < 8),
crc as (select list(c order by i) as t from steps where k = 8)
"""

QUERIES = {"op13_spelling": op13_spelling}
ORACLES = {
    "op13_spelling": r"""
with recursive """
    + CRC.strip()
    + r""",
r as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
g as (select id, run, count(*) as times from r group by 1, 2),
b as (select *, list_prepend(4294967295::bigint, list_transform(string_split(regexp_replace(hex(encode(id || ':' || run)), '(..)', '\1 ', 'g').rtrim(), ' '), lambda x: ('0x' || x)::utinyint::bigint)) as bytes from g),
h as (select b.id, run, times, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::bigint) as h from b, crc),
v as (select case when h % 97 = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word, times from h),
w as (select word, sum(times)::bigint as n from v where length(word) >= 5 group by 1 having sum(times) >= 3),
cuts as (select word, n, p, substring(word, 1, p::int) || substring(word, p::int + 2) as rest from (select word, n, unnest(range(length(word))) as p from w)),
near as (select a.word, b.word as near, b.n as near_n from cuts a join cuts b on a.p = b.p and a.rest = b.rest and a.word <> b.word and length(a.word) = length(b.word)
         union select cuts.word, w.word, w.n from cuts join w on cuts.rest = w.word
         union select w.word, cuts.word, cuts.n from cuts join w on cuts.rest = w.word),
agg as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as near, max(near_n) as near_n from near group by 1),
f as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 2 * w.n then near end as form, case when near_n >= 2 * w.n then near_n end as form_n from w left join agg on w.word = agg.word),
walk as (select word, word as here, 0 as k from f union all select walk.word, f.form, k + 1 from walk join f on f.word = walk.here where f.form is not null),
ends as (select word, arg_max(here, k) as root from walk group by 1)
select f.word, f.n, f.n_near, f.form, f.form_n, ends.root from f join ends on f.word = ends.word
"""
}
