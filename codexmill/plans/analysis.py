"""Queries of repetition, parts of exports, ledgers and candidates of evidence, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import ids as I
from codexmill.functions import text as X
from codexmill.operators import export as E
from codexmill.operators import ledger as G
from codexmill.operators import pointers as P
from codexmill.operators import repetition as N
from codexmill.operators import tables as T
from codexmill.operators import verify as V
from codexmill.operators.orphans import json_string_list
from codexmill.session import table as t
from codexmill.sources import config as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ repetition


def _pointers(s: SparkSession, d: str) -> DataFrame:
    """Every record of every work as a pointer; a quarter has no blob."""
    ids = t(s, d, "works").select(F.col("work_id").alias("query_id"), F.col("work_id").alias("query")).distinct()
    rows = P.identifier_rows(t(s, d, "records"), ids)
    return rows.select(
        "query_id", F.lit(1).cast("long").alias("rank"), "score", "match_reasons", F.col("id").alias("record_id"), "corpus", F.col("corpus").alias("repository"), "source_sha", "source_path",
        F.when(F.col("id") % 4 != 0, F.sha1("source_path")).alias("source_blob_sha"), F.col("source_path").alias("indexed_source_path"), "work_id", "segment_id", "sequence_no", "evidence_class", "text_role", "witness",
    )


# Weights of the evidence classes.
_CLASS = "case {0} when 'canonical_root' then 70 when 'authoritative_structured' then 65 when 'metadata_relationship' then 35 when 'parallel_alignment' then 25 when 'computational_segmented' then 15 when 'derived_critical_lemma' then 30 when 'auxiliary_reference' then 10 else 0 end"
_PTR = f"""
with k as (select distinct work_id as query_id from works),
 ptr as (select k.query_id, cast(1 as bigint) as rank, cast({_CLASS.format("evidence_class")} + 120 + case when coalesce(segment_id, '') <> '' then 5 else 0 end as bigint) as score, ['exact'] as match_reasons,
   id as record_id, corpus, corpus as repository, source_sha, source_path, case when id % 4 <> 0 then sha1(source_path) end as source_blob_sha, source_path as indexed_source_path, r.work_id, segment_id, sequence_no, evidence_class, text_role, witness
   from k join (select *, work_id as key from records union all select *, segment_id from records where segment_id is distinct from work_id) r on r.key = k.query_id)
"""


def _json(fields: tuple[str, ...]) -> str:
    return "cast(json_object(" + ", ".join(f"'{f}', {f}" for f in fields) + ") as varchar)"


def _bytes(c: str) -> str:
    return f"octet_length(encode({c}))"


@query(
    _PTR
    + ", g as ("
    + " union all ".join(f"select '{n}' as grouping_, {_json(f)} as j from ptr" for n, f in N.GROUPINGS.items())
    + """), n as (select grouping_, j, count(*) as n from g group by all)
      select grouping_ as "grouping", cast(sum(n) as bigint) as total, count(*) as "unique", cast(sum(n) - count(*) as bigint) as duplicates, cast(quantile_disc(n, 0.5) as bigint) as median_reuse, cast(quantile_disc(n, 0.95) as bigint) as p95_reuse, max(n) as max_reuse from n group by grouping_"""
)
def repetition_groupings(s, d):
    return N.repetition(_pointers(s, d))


@query(_PTR + "select repository, source_sha, source_path, source_blob_sha, count(*) as reuse from ptr group by all order by reuse desc, repository, source_sha, source_path, source_blob_sha nulls first limit 20")
def top_reused_sources(s, d):
    return N.top_reused(_pointers(s, d))


_PARTS = {"file": N.INDEXED, "query": N.OF_QUERY, "work_and_segment": tuple(f for f in N.POINTER if f not in (*N.INDEXED, *N.OF_QUERY))}


@query(_PTR + " union all ".join(f"select '{n}' as part, cast(sum({' + '.join(_bytes(_json((x,))) + ' - 2' for x in f)}) as bigint) as bytes from ptr" for n, f in _PARTS.items()))
def pointer_field_bytes(s, d):
    return N.field_bytes(_pointers(s, d))


_TABLES = {"source": N.INDEXED, "work_ref": N.WORK}
_LEFT = tuple(f for f in N.POINTER if f not in (*N.INDEXED, *N.WORK))
_REFS = sum(len(f'"{n}_id":"",') + N.ID_CHARS for n in _TABLES)


@query(
    _PTR
    + f"select 'as they are' as name, count(*) as records, cast(sum({_bytes(_json(N.POINTER))}) as bigint) as bytes from ptr union all select 'with references', count(*), cast(sum({_bytes(_json(_LEFT))} + {_REFS}) as bigint) from ptr"
    + "".join(f""" union all select '{n}', count(*), cast(sum({_bytes("j")} + {len(f'"{n}_id":"",') + N.ID_CHARS}) as bigint) from (select distinct {_json(f)} as j from ptr)""" for n, f in _TABLES.items())
)
def pointer_tables_simulated(s, d):
    return N.simulate(_pointers(s, d), _TABLES)


@query(
    _PTR
    + """, asked as (select distinct coalesce(title, '') as query_id from works union select query_id from k),
      per as (select query_id, count(*) as n, count(*) - count(distinct record_id) as again, count(*) filter (source_blob_sha is null) as blobless from ptr group by query_id)
      select count(*) as n_queries, count(*) filter (per.n is null) as n_no_result, cast(sum(per.n) as bigint) as n_pointers, cast(sum(blobless) as bigint) as n_null_blob, cast(sum(again) as bigint) as n_repeated, cast(0 as bigint) as n_with_text from asked left join per using (query_id)"""
)
def pointer_quality(s, d):
    """The pointers of every work and title; no title is an identifier."""
    w = t(s, d, "works")
    asked = w.select(F.col("work_id").alias("query_id")).unionByName(w.select(F.coalesce("title", F.lit("")).alias("query_id"))).distinct()
    return N.pointer_quality(asked, _pointers(s, d))


# ------------------------------------------------------------------ parts of exports


def _part_sql(table: str, by: str, order: str, line: str, target: int, key: str) -> str:
    return f"""with l as (select *, {_bytes(line)} + 1 as n_bytes from {table}), r as (select *, sum(n_bytes) over (partition by {by} order by {order} rows unbounded preceding) as run from l)
       select {by}, cast((run - 1) // {target} as bigint) as part, count(*) as items, cast(sum(n_bytes) as bigint) as bytes, min({key}) as first_key, max({key}) as last_key from r group by {by}, cast((run - 1) // {target} as bigint)"""


_RELATION = ("id", "corpus", "relation_type", "from_id", "to_id", "source_path", "details_json", "source_sha", "evidence_class")


@query(_part_sql("relations", "corpus", "id", _json(_RELATION), 4096, "id"))
def relation_parts(s, d):
    p = E.parts(t(s, d, "relations").select(*_RELATION), ["corpus"], ["id"], 4096)
    return E.part_stats(p, ["corpus"], "id")


_VARIANT = ("id", "corpus", "work_id", "segment_id", "lemma", "reading", "witnesses", "variant_type", "notes", "source_path", "source_sha", "evidence_class")


@query(_part_sql("variants", "corpus", "id", _json(_VARIANT), 4096, "id"))
def variant_parts(s, d):
    p = E.parts(t(s, d, "variants").select(*_VARIANT), ["corpus"], ["id"], 4096)
    return E.part_stats(p, ["corpus"], "id")


@query(
    _part_sql("(select 'lemma' as namespace, substr(sha256(key), 1, 2) as bucket, key, n from (select lemma as key, count(*) as n from lemmas where lemma <> '' group by lemma))", "namespace, bucket", "key", _json(("namespace", "bucket", "key", "n")), 100, "key")
)
def locator_parts(s, d):
    """A locator of lemmas in parts by namespace and bucket."""
    k = t(s, d, "lemmas").filter("lemma <> ''").groupBy(F.col("lemma").alias("key")).agg(F.count("*").alias("n"))
    k = k.select(F.lit("lemma").alias("namespace"), I.bucket(F.col("key")).alias("bucket"), "key", "n")
    return E.part_stats(E.parts(k, ["namespace", "bucket"], ["key"], 100), ["namespace", "bucket"], "key")


_LINE = _bytes(_json(E.EXPORT)) + " + 1"
_SHARDS = f"""
with l as (select *, {_LINE} as n_bytes from records), r as (select *, sum(n_bytes) over (partition by corpus order by work_id nulls first, source_path, sequence_no, id rows unbounded preceding) as run,
   row_number() over (order by corpus, work_id nulls first, source_path, sequence_no, id) as place from l),
 s as (select *, cast((run - 1) // {E.SHARD_BYTES} as bigint) as shard from r)
"""


@query(_SHARDS + "select corpus, shard, count(*) as items, cast(sum(n_bytes) as bigint) as bytes, min(id) as first_id, max(id) as last_id, count(distinct work_id) as works, min(work_id) as first_work, max(work_id) as last_work from s group by corpus, shard")
def shard_stats(s, d):
    return E.shard_stats(E.shards(t(s, d, "records")))


@query(
    _SHARDS
    + """select corpus, shard, id, 'primary' as role from s
         union all select distinct a.corpus, a.shard, b.id, 'context_overlap' from s a join s b on a.corpus = b.corpus and abs(a.place - b.place) between 1 and 2 and a.shard <> b.shard"""
)
def shard_overlap(s, d):
    r = t(s, d, "records")
    return E.overlap(r, E.shards(r))


# ------------------------------------------------------------------ ledgers

_REPLACES = "case id % 5 when 0 then id - 1 when 1 then id - 2 when 2 then id + 3 when 3 then id + 100000000 end"


@query(
    f"""with i as (select id, {_REPLACES} as r from relations), j as (select i.id, i.r, o.id as o from i left join relations o on o.id = i.r),
        p as (select *, case when r is null then null when o is null then 'missing' when o >= id then 'not earlier' end as problem from j),
        f as (select r, min(id) as first from p where r is not null and problem is null group by r)
        select p.id, case when g.r is not null then 'superseded' else 'active' end as status, case when problem is null and p.r is not null and f.first <> p.id then 'branch' else problem end as problem
        from p left join f on f.r = p.r left join f g on g.r = p.id"""
)
def supersede_chain(s, d):
    items = t(s, d, "relations").select("id", F.expr(_REPLACES).alias("supersedes"), F.col("id").alias("at"))
    return G.supersession(items).select("id", "status", "problem")


@query(
    """with e as (select distinct id, unnest(json_extract_string(relation_ids, '$[*]')) as c from records where json_valid(relation_ids) and json_type(relation_ids) = 'ARRAY'),
        h as (select e.id, c, exists (select 1 from records s where s.segment_id = e.c) as there from e where c is not null)
        select r.id, count(c) as n_cited, count(*) filter (there) as n_found, coalesce(string_agg(c, '|' order by c) filter (not there), '') as missing, count(*) filter (not there) = 0 as complete from records r left join h on h.id = r.id group by r.id"""
)
def citations_complete(s, d):
    r = t(s, d, "records")
    items = r.select("id", json_string_list(F.col("relation_ids")).alias("ids"))
    return G.citations(items, r.select("segment_id"), cited_key="segment_id").select("id", "n_cited", "n_found", F.array_join("missing", "|").alias("missing"), "complete")


@query(
    """with f as (select corpus, work_id, count(distinct source_path) as n, min(source_path) as p from records group by corpus, work_id)
       select w.corpus, w.work_id, coalesce(n, 0) as n_files, case when n = 1 then p end as source_path, case when coalesce(n, 0) = 0 then 'missing' when n = 1 then 'found' else 'ambiguous' end as status
       from (select distinct corpus, work_id from works) w left join f on f.corpus = w.corpus and f.work_id = w.work_id"""
)
def declared_sources(s, d):
    return G.declared_sources(t(s, d, "works"), t(s, d, "records"))


@query("select case when length(k) >= 4 then '4+' else cast(length(k) as varchar) end as category, count(*) as n from (select distinct lower(lemma) as k from lemmas where lemma <> '') where k in (select distinct regexp_replace(trim(lower(lemma)), '\\s+', ' ', 'g') from lemmas) group by 1")
def category_lookup(s, d):
    """Keys of the universe by category, joined on kind and key."""
    lem = t(s, d, "lemmas")
    keys = P.key_universe(lem, t(s, d, "records"))
    k = lem.select(X.normalize("lemma").alias("key")).filter("key <> ''").distinct()
    cat = k.select(F.lit("term").alias("query_kind"), "key", X.length_bucket(F.col("key")).alias("category"))
    return G.with_category(keys, cat).groupBy("category").agg(F.count("*").alias("n"))


@query(
    """with e as (select id, case when json_valid(relation_ids) then case when json_type(relation_ids) = 'ARRAY' then json_extract_string(relation_ids, '$[*]') end end as x from records)
       select id, coalesce(len(x) <= 8 and len(list_distinct(x)) = len(x) and len(list_filter(x, lambda y: y is null or trim(y) = '' or length(y) > 24)) = 0, false) as ok from e"""
)
def list_predicates(s, d):
    x = json_string_list(F.col("relation_ids"))
    return t(s, d, "records").select("id", G.valid_list(x, 8, 24).alias("ok"))


@query("select id, length(morphology_json) > 2 as changed, true as same, false as typed from lemmas")
def json_equality(s, d):
    """Morphology with other blanks is the same, with another entry it is not; a number is no truth value."""
    lem = t(s, d, "lemmas")
    c = lambda x: G.canonical_json(x)
    m = F.col("morphology_json")
    wide = F.replace(F.replace(m, F.lit(":"), F.lit(" : ")), F.lit("{"), F.lit("{ "))
    more = F.replace(m, F.lit('{"'), F.lit('{"!": 1, "'))
    pair = F.concat(F.lit('{"a": 1, "m": '), m, F.lit("}")), F.concat(F.lit('{"a": true, "m": '), m, F.lit("}"))
    return lem.select("id", (c(m) != c(more)).alias("changed"), (c(m) == c(wide)).alias("same"), (c(pair[0]) == c(pair[1])).alias("typed"))


# ------------------------------------------------------------------ evidence


@query(
    """select r.id, s.corpus as repository, case when starts_with(r.source_path, r.corpus || '/') and length(r.source_path) > length(r.corpus) + 1 then substring(r.source_path, length(r.corpus) + 2) end as source_path, r.source_path as indexed_source_path, 'CANDIDATE' as state
       from records r left join (select corpus from source_state where corpus <> 'millpond') s on s.corpus = r.corpus where s.corpus is not null
       union all select id, null, null, source_path, 'CANDIDATE' from records where corpus = 'millpond'"""
)
def evidence_candidates(s, d):
    """Candidates of every record; one corpus has no repository."""
    src = t(s, d, "source_state").filter("corpus <> 'millpond'").select("corpus", F.col("corpus").alias("repo_path"), F.col("corpus").alias("repository"))
    return V.evidence_candidates(t(s, d, "records"), src).select("id", "repository", "source_path", "indexed_source_path", "state")


@query("select id, case when id % 3 = 0 or id % 3 = 1 then 'authoritative_structured' else evidence_class end as expected from records")
def contract_by_path(s, d):
    kind = F.element_at(F.array(F.lit("translation/"), F.lit("comment/"), F.lit("root/")), (F.col("id") % 3 + 1).cast("int"))
    return t(s, d, "records").select("id", V.contract_class(F.concat(kind, "source_path"), F.col("evidence_class")).alias("expected"))


@query("select cast(id as varchar) as evidence_id, case id % 4 when 1 then 'source_path' when 2 then 'segment_id|sequence_no' when 3 then 'corpus|source_sha|source_path|work_id|segment_id|sequence_no' else '' end as differs, id % 4 = 0 as bound from records")
def pointer_bindings(s, d):
    """Hits at the place of their record, in another file, at another place, and without a record."""
    r = t(s, d, "records").withColumn("evidence_id", F.col("id").cast("string"))
    k = F.col("id") % 4
    hits = r.withColumn("source_path", F.when(k == 1, F.concat("source_path", F.lit("x"))).otherwise(F.col("source_path")))
    hits = hits.withColumn("segment_id", F.when(k == 2, F.concat(F.coalesce("segment_id", F.lit("")), F.lit("x"))).otherwise(F.col("segment_id"))).withColumn("sequence_no", F.when(k == 2, F.col("sequence_no") + 1).otherwise(F.col("sequence_no")))
    got = V.bindings(hits, r.filter(k != 3))
    return got.select("evidence_id", F.array_join("differs", "|").alias("differs"), "bound")


@query(
    """with i as (select id, case id % 4 when 0 then 'TITLE' when 1 then 'IDENTIFIER' when 2 then 'QUOTE' else 'OTHER' end as kind, case id % 4 when 0 then title when 1 then work_id when 2 then raw_text else 'x' end as v, id % 3 = 0 as off from records)
       select id as item_id, case when trim(coalesce(v, '')) = '' or kind = 'OTHER' then 'UNVERIFIED' when off then 'MISMATCH' else 'VERIFIED_EXACT' end as status from i"""
)
def output_items(s, d):
    """Titles, identifiers and whole texts of records, of which a third is altered."""
    r, k = t(s, d, "records"), F.col("id") % 4
    v = F.when(k == 0, F.col("title")).when(k == 1, F.col("work_id")).when(k == 2, F.col("raw_text")).otherwise("x")
    kind = F.when(k == 0, "TITLE").when(k == 1, "IDENTIFIER").when(k == 2, "QUOTE").otherwise("OTHER")
    v = F.when(F.btrim(F.coalesce(v, F.lit(""))) != "", F.when(F.col("id") % 3 == 0, F.concat(v, F.lit("≠"))).otherwise(v))
    items = r.select(F.col("id").alias("item_id"), kind.alias("kind"), v.alias("value"), F.col("id").cast("string").alias("evidence_id"))
    ev = r.select(F.col("id").cast("string").alias("evidence_id"), F.col("raw_text").alias("text"), "title", "work_id", "segment_id")
    return V.output_items(items, ev).select("item_id", "status")


@query("select corpus, repo_path, source_sha, evidence_class from source_state")
def source_config(s, d):
    """The sources as a configuration file, read back."""
    st = t(s, d, "source_state").select("corpus", "repo_path", "source_sha", "evidence_class").collect()  # one row a corpus
    import json

    return C.sources_of(s, json.dumps({"sources": {r.corpus: {k: r[k] for k in ("repo_path", "source_sha", "evidence_class")} for r in st}}))


# ------------------------------------------------------------------ scalars


@query(
    """select id, case when coalesce(segment_id, '') <> '' then split_part(split_part(segment_id, ':', 1), '#', 1) end as work,
        coalesce(nullif(regexp_replace(regexp_replace(coalesce(title, segment_id, ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') as slug,
        case when starts_with(source_path, 'palmleaf/') and length(source_path) > 9 then substring(source_path, 10) end as inner_path,
        case when regexp_full_match(trim(x), '(?i)[a-z]{1,4}[0-9]{1,3}n[0-9]{4,5}[a-z]?') then upper(regexp_extract(trim(x), '^([A-Za-z]+)', 1)) || lpad(regexp_extract(trim(x), '^[A-Za-z]+([0-9]+)', 1), 2, '0') || 'n' || lower(regexp_extract(trim(x), '[nN]([0-9]{4,5}[a-zA-Z]?)$', 1)) end as work_norm,
        regexp_full_match(source_sha, '[0-9a-f]{40}') as sha, octet_length(encode(cast(json_object('title', title) as varchar))) - 2 as title_bytes
       from (select *, ' ' || lower(replace(coalesce(work_id, ''), 'n0', 'n')) || ' ' as x from records)"""
)
def id_functions(s, d):
    r = t(s, d, "records")
    x = F.concat(F.lit(" "), F.lower(F.replace(F.coalesce("work_id", F.lit("")), F.lit("n0"), F.lit("n"))), F.lit(" "))
    return r.select(
        "id", I.work_from_segment(F.col("segment_id")).alias("work"), I.slug(F.coalesce("title", "segment_id", F.lit(""))).alias("slug"), I.relative_path(F.col("source_path"), "palmleaf").alias("inner_path"),
        I.normalize_work_id(x).alias("work_norm"), I.is_sha(F.col("source_sha")).alias("sha"), I.fragment_bytes("title", F.col("title")).alias("title_bytes"),
    )


_PATHS = "case id % 6 when 0 then source_path when 1 then '/' || source_path when 2 then source_path || '/../x' when 3 then replace(source_path, '/', '\\') when 4 then source_path || '/' else replace(source_path, '/', '//') end"


@query("select id, id % 6 = 0 and source_path <> '' as ok from records")
def path_rules(s, d):
    return t(s, d, "records").select("id", I.valid_path(F.expr(_PATHS.replace("\\", "\\\\"))).alias("ok"))


@query("select id, case id % 3 when 0 then cast(floor(epoch(ingested_at)) as bigint) when 1 then cast(floor(epoch(ingested_at)) as bigint) - 7200 else -1 end as seconds from records")
def aware_times(s, d):
    """Texts with Z, with an offset of two hours, and without any, which is no time: seconds since 1970, or -1."""
    base, k = F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss"), F.col("id") % 3
    text = F.when(k == 0, F.concat(base, F.lit("Z"))).when(k == 1, F.concat(base, F.lit("+02:00"))).otherwise(base)
    return t(s, d, "records").select("id", F.coalesce(F.unix_seconds(I.aware_timestamp(text)), F.lit(-1)).alias("seconds"))


@query("select id, id % 5 in (0, 4) as ok, id % 5 = 4 as within from records where length(raw_text) >= 4")
def range_checks(s, d):
    """Ranges that are whole, reversed, too long, negative, and inner."""
    r, n, k = t(s, d, "records").filter(F.length("raw_text") >= 4), F.length("raw_text"), F.col("id") % 5
    whole = F.array(F.lit(0), n)
    span = F.when(k == 0, whole).when(k == 1, F.array(n, F.lit(0))).when(k == 2, F.array(F.lit(0), n + 1)).when(k == 3, F.array(F.lit(-1), n)).otherwise(F.array(F.lit(1), n - 1))
    return r.select("id", V.range_ok(F.col("raw_text"), span).alias("ok"), (V.contains_range(whole, span) & ~V.contains_range(span, whole) & V.range_ok(F.col("raw_text"), span)).alias("within"))


@query("select id, case id % 3 when 0 then true when 1 then false end as ok from relations")
def strict_json(s, d):
    """Details as they are, with a key twice, and none."""
    k = F.col("id") % 3
    twice = F.concat(F.lit('{"a": 1, "a": '), "details_json", F.lit("}"))
    return t(s, d, "relations").select("id", V.strict_json(F.when(k == 0, F.col("details_json")).when(k == 1, twice)).alias("ok"))


@query("select cast(round_even(1000 * least(m, a), 0) as bigint) as lower, cast(round_even(1000 * a, 0) as bigint) as central, cast(round_even(1000 * greatest(a, p), 0) as bigint) as upper from (select avg(n) as a, quantile_disc(n, 0.5) as m, quantile_disc(n, 0.95) as p from (select length(raw_text) as n from records))")
def extrapolated(s, d):
    r = t(s, d, "records").select(F.length("raw_text").cast("long").alias("n"))
    return P.extrapolate(P.distribution(r, "n"), 1000)


# ------------------------------------------------------------------ tables and keys


@query("select id from records where regexp_matches(raw_text, '[^\\s\\p{Z}]') and corpus <> 'palmleaf'")
def kept_rows(s, d):
    """Rows with text, without one corpus."""
    return T.purge(T.drop_blank(t(s, d, "records")), "palmleaf").select("id")


@query(
    """with m as (select distinct lower(nfc_normalize(surface)) as s, lower(nfc_normalize(lemma)) as l from lemmas where surface <> '' and lemma <> '')
       select s as surface, l as lemma from m union select strip_accents(s), l from m"""
)
def surface_lemmas(s, d):
    return E.surface_map(t(s, d, "lemmas"))


@query("select id, lower(nfc_normalize(work_id)) as key from records where work_id <> '' union select id, lower(nfc_normalize(segment_id)) from records where segment_id <> ''")
def locator_identifiers(s, d):
    return E.locator_keys(t(s, d, "records")).filter("namespace = 'identifier'").select("id", "key")


@query(
    _SHARDS
    + r""", c as (select s.corpus, shard, regexp_replace(lower(nfc_normalize(raw_text)), '[^\p{L}\p{N}]+', '', 'g') as c from s),
       runs as (select corpus, shard, unnest(regexp_extract_all(c, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]+')) as r from c),
       k as (select distinct 'cjk' as namespace, substring(r, x.i, 2) as key, corpus, shard from runs, lateral (select unnest(range(1, length(r))) as i) x where length(r) >= 2
             union select 'identifier', lower(nfc_normalize(work_id)), corpus, shard from s where work_id <> '' union select 'identifier', lower(nfc_normalize(segment_id)), corpus, shard from s where segment_id <> '')
       select namespace, count(distinct key) as keys, count(*) as entries from k group by namespace"""
)
def locator_summary(s, d):
    """Keys and entries of the locator, but for Latin tokens."""
    r = t(s, d, "records")
    return E.locator_stats(E.locator(r, E.shards(r))).filter("namespace <> 'latin'")


@query(
    _PTR
    + """, best as (select *, row_number() over (partition by query_id, corpus, work_id, source_path order by score desc, sequence_no, record_id) as b from ptr),
       kept as (select *, row_number() over (partition by query_id, corpus order by score desc, source_path, sequence_no, record_id) as c from best where b = 1),
       top as (select *, row_number() over (partition by query_id order by score desc, corpus, source_path, sequence_no, record_id) as place from kept where c <= 5)
       select query_id, count(*) as n, string_agg(substring(source_path, length(corpus) + 2), ' ' order by place) as paths, string_agg(coalesce(case when record_id % 4 <> 0 then sha1(source_path) end, '-'), ' ' order by place) as blobs from top group by query_id"""
)
def pointer_lists(s, d):
    """The best pointers of every work, with repository and blob; a quarter of the paths has no blob."""
    r = t(s, d, "records")
    ids = t(s, d, "works").select(F.col("work_id").alias("query_id"), F.col("work_id").alias("query")).distinct()
    rows = P.best_sources(P.identifier_rows(r, ids), 5)
    src = t(s, d, "source_state").select("corpus", F.col("corpus").alias("repo_path"), F.concat(F.lit("host/"), "corpus").alias("repository"))
    got = P.pointers(rows, src).select("query_id", F.posexplode("pointers").alias("at", "p"))
    got = got.withColumn("blob", F.when(F.col("p.record_id") % 4 != 0, F.sha1("p.indexed_source_path")).otherwise("-"))
    join = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", c.alias("v")))), lambda x: x["v"]), " ")
    return got.groupBy("query_id").agg(F.count("*").alias("n"), join(F.col("p.source_path")).alias("paths"), join(F.col("blob")).alias("blobs"))


@query(
    """with w as (select id, lag(id) over w as p1, lag(id, 2) over w as p2, lead(id) over w as n1, lead(id, 2) over w as n2 from records window w as (partition by corpus, work_id, source_path order by sequence_no, id)),
        x as (select id, unnest([-2, -1, 1, 2]) as off, unnest([p2, p1, n1, n2]) as neighbour from w)
       select id, cast(off as bigint) as "offset", neighbour from x where neighbour is not null and id in (select id from relations where relation_type = 'mention')"""
)
def context_of_some(s, d):
    """Neighbours of the records with the ids of some relations; only their files are put in order."""
    from codexmill.operators import lookup as L

    return L.context(t(s, d, "records"), 2, t(s, d, "relations").filter("relation_type = 'mention'").select("id"))
