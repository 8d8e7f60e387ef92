"""Queries of the core operators over the corpus tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexmill.operators import orphans
from codexmill.session import table as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": lambda s, d: orphans.orphan_references(t(s, d, "records"), t(s, d, "works")).select("id", "field", "ref", "status"),
    "p2_report": lambda s, d: orphans.orphan_report(t(s, d, "records"), t(s, d, "works")),
}

_ORPHANS = """
with e as (
  select distinct id, ingested_at, unnest(json_extract_string(relation_ids, '$[*]')) as ref
  from records where json_valid(relation_ids) and json_type(relation_ids) = 'ARRAY'
), refs as (
  select id, 'work_id' as field, work_id as ref, ingested_at as seen, corpus, work_id as work from records where work_id <> ''
  union all
  select id, 'relation_ids', ref, ingested_at, null, split_part(split_part(ref, ':', 1), '#', 1) from e where ref <> ''
), hit as (
  select r.id, r.field, r.ref, r.seen, count(w.work_id) as n, min(w.ingested_at) as first,
         coalesce(bool_or(w.ingested_at <= r.seen and (w.deleted_at is null or w.deleted_at > r.seen)), false) as holds
  from refs r left join works w on w.work_id = r.work and (r.corpus is null or w.corpus = r.corpus)
  group by r.id, r.field, r.ref, r.seen
), o as (
  select id, field, ref, seen, case when n = 0 then 'missing' when first > seen then 'late' else 'deleted' end as status from hit where not holds
)
"""

ORACLE = {
    "p2_found": _ORPHANS + "select id, field, ref, status from o",
    "p2_report": _ORPHANS
    + """select field, strftime(seen, '%Y-%m') as month, status, count(*) as n_refs, count(distinct id) as n_records
         from o group by field, strftime(seen, '%Y-%m'), status""",
}
