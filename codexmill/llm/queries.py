"""Queries of the operators for training texts, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexmill.llm import encoding, leakage, lookalike, packing, sentences, spans, splitting, terms
from codexmill.session import spread, table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def t(s: SparkSession, d: str, name: str) -> DataFrame:
        return spread(table(s, d, name))  # tables of a few row groups only

    return {
        "p1_found": lambda s, d: spans.shared_spans(t(s, d, "records")),
        "p1_report": lambda s, d: spans.shared_report(t(s, d, "records")),
        "p3_found": lambda s, d: terms.record_terms(t(s, d, "records")).filter("mark is not null").select("field", "term", "mark"),
        "p3_counts": lambda s, d: terms.record_terms(t(s, d, "records")).select("field", "term", "occurrences", "records"),
        "p4_found": lambda s, d: sentences.split_sentences(t(s, d, "records")),
        "p5_found": lambda s, d: splitting.oversized(t(s, d, "records")),
        "p5_pieces": lambda s, d: splitting.split_oversized(t(s, d, "records")),
        "p6_found": lambda s, d: lookalike.same_look(t(s, d, "records")),
        "p6_classes": lambda s, d: lookalike.look_classes(t(s, d, "records")),
        "p6_unified": lambda s, d: lookalike.unify_all(t(s, d, "records")),
        "p7_containers": lambda s, d: packing.fill_containers(t(s, d, "documents")),
        "p7_fill": lambda s, d: packing.fill_report(t(s, d, "documents")),
        "p8_found": lambda s, d: leakage.leaked_passages(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_report": lambda s, d: leakage.leak_report(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_found": lambda s, d: encoding.garbled_texts(t(s, d, "documents")).select("doc_id"),
        "p9_restored": lambda s, d: encoding.garbled_texts(t(s, d, "documents")),
    }


_SHARED = """
with w as (
  select id, x.i as i, substring(raw_text, x.i + 1, 80) as t
  from records, lateral (select unnest(range(0, length(raw_text) - 79)) as i) x
  where length(raw_text) >= 80
), m as (select t from w group by t having min(id) <> max(id)),
 hit as (select w.id, w.i from w join m on w.t = m.t),
 mark as (select id, i, case when lag(i) over (partition by id order by i) >= i - 80 then 0 else 1 end as n from hit),
 run as (select id, i, sum(n) over (partition by id order by i) as g from mark),
 span as (select id, min(i) as start_char, max(i) + 80 as end_char from run group by id, g)
"""

_TERMS = """
with tok as (
  select 'lemma_text' as field, id, unnest(regexp_extract_all(lemma_text, '[\\p{L}\\p{M}\\p{N}]+')) as term from records
  union all
  select 'norm_text', id, unnest(regexp_extract_all(norm_text, '[\\p{L}\\p{M}\\p{N}]+')) from records
  where language in ('pli', 'san', 'en', 'de', 'vi')
), c as (select field, term, count(*) as occurrences, count(distinct id) as records from tok group by field, term)
"""

_WIDE = (
    "list_max(list_transform(regexp_split_to_array(raw_text, "
    "'[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}.!?;:,…|।॥་༌།༎。！？；：，、｡､]'), lambda x: length(x)))"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _SHARED + "select id, start_char, end_char from span",
        "p1_report": _SHARED
        + """select r.id, r.witness, count(*) as n_spans, cast(sum(end_char - start_char) as bigint) as shared_chars, length(r.raw_text) as n_chars
             from span join records r on r.id = span.id group by r.id, r.witness, r.raw_text""",
        "p3_found": _TERMS
        + """select field, term, case when records >= 0.05 * (select count(*) from records) then 'common' else 'rare' end as mark
             from c where records >= 0.05 * (select count(*) from records) or records <= 2""",
        "p3_counts": _TERMS + "select field, term, occurrences, records from c",
        "p5_found": f"select id, case when {_WIDE} > 2000 then 'forced' else 'natural' end as cut from records where length(raw_text) > 2000",
    }
