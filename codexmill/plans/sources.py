"""Queries of the source formats: the corpus tables are rendered as source files, which the parsers read back.

A file is what one source path holds, so rendering gathers no more than a parser reads at once.
The files are rows (source_path, content), as ``sources.files.read_files`` gives them for a folder.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.session import table as t
from codexmill.sources import aligned as A
from codexmill.sources import files as S
from codexmill.sources import formats as P
from codexmill.sources import spans as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ rendering


def js(c: Column) -> Column:
    """A JSON string, or null."""
    one = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substring(one, F.lit(2), F.length(one) - 2)


def xml(c: Column, quotes: bool = True) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rendered(df: DataFrame, path: Column, item: Column, order: list[str], head: Column | str = "", tail: str = "", sep: str = "\n") -> DataFrame:
    """(source_path, content): the items of every path in order, between head and tail."""
    head = F.lit(head) if isinstance(head, str) else head
    g = df.groupBy(path.alias("source_path")).agg(F.sort_array(F.collect_list(F.struct(*order, item.alias("_item")))).alias("_i"), F.min(head).alias("_h"))
    body = F.array_join(F.transform("_i", lambda x: x["_item"]), sep)
    return g.select("source_path", F.encode(F.concat("_h", body, F.lit(tail)), "UTF-8").alias("content"))


SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}]"
_ORDER = ["sequence_no", "id"]


def _flat() -> Column:
    return F.replace(F.col("source_path"), F.lit("/"), F.lit("."))


def _work() -> Column:
    return F.coalesce("work_id", F.lit("none"))


def _lang() -> Column:
    return F.coalesce("language", F.lit("und"))


def _blank(c: Column) -> Column:
    return ~c.rlike(r"[^\s\p{Z}\x1c-\x1f\x85\x0b]")


def _segments(s: SparkSession, d: str) -> DataFrame:
    """Records as JSON objects of segments, with markup around every text that is not blank."""
    r = t(s, d, "records")
    text = F.when(_blank(F.col("raw_text")), F.col("raw_text")).otherwise(F.concat(F.lit("<b>"), "raw_text", F.lit("</b> &amp;")))
    path = F.concat(F.lit("root/"), _lang(), F.lit("/"), "corpus", F.lit("/"), _flat(), F.lit("_root-mill.json"))
    return rendered(r, path, F.concat(js(F.concat(_work(), F.lit(":"), F.col("id").cast("string"))), F.lit(": "), js(text)), _ORDER, "{", "}", ", ")


_SEG = f"""
with f as (select *, coalesce(work_id, 'none') || ':' || id as seg, coalesce(language, 'und') as lang, ' ' || raw_text || '  &' as txt,
    row_number() over (partition by coalesce(language, 'und'), corpus, source_path order by sequence_no, id) - 1 as no from records),
 n as (select *, row_number() over (partition by lang, corpus, source_path order by sequence_no, id) - 1 as k from f where regexp_matches(raw_text, '[^\\s\\p{{Z}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{0b}}]'))
"""


@query(_SEG + "select seg as segment_id, split_part(split_part(seg, ':', 1), '#', 1) as work_id, lang as language, 'root:root-mill' as witness, txt as raw_text, no as sequence_no, 'root_text' as text_role, 'canonical_root' as evidence_class from n")
def scan_segment_json(s, d):
    rows = S.parse(_segments(s, d), P.segment_json())
    return rows.filter("kind = 'record'").select("segment_id", "work_id", "language", "witness", "raw_text", "sequence_no", "text_role", "evidence_class")


@query(
    _SEG
    + """, c as (select lang, corpus, source_path, k // 50 as sequence_no, count(*) as n, arg_min(seg, k) as first, arg_max(seg, k) as last, string_agg(txt, ' ' order by k) as raw_text from n group by lang, corpus, source_path, k // 50)
       select first || '..' || last as segment_id, first || '|' || last as ends, sequence_no, raw_text, split_part(split_part(first, ':', 1), '#', 1) as work_id from c"""
)
def scan_segment_chunks(s, d):
    rows = S.parse(_segments(s, d), P.segment_json(chunked=True))
    return rows.select("segment_id", F.array_join("relation_ids", "|").alias("ends"), "sequence_no", "raw_text", "work_id")


@query("select coalesce(segment_id, 'none') || ':' || id as segment_id, reading, 'variant-mill' as witnesses, 'segment_variant' as variant_type, 'canonical_root' as evidence_class from variants where trim(reading) <> ''")
def scan_segment_variants(s, d):
    v = t(s, d, "variants")
    path = F.concat(F.lit("variant/pli/"), "corpus", F.lit("/"), _flat(), F.lit("_variant-mill.json"))
    key = F.concat(F.coalesce("segment_id", F.lit("none")), F.lit(":"), F.col("id").cast("string"))
    return S.parse(rendered(v, path, F.concat(js(key), F.lit(": "), js(F.col("reading"))), ["id"], "{", "}", ", "), P.segment_json()).select("segment_id", "reading", "witnesses", "variant_type", "evidence_class")


@query(
    """with e as (select distinct source_path, relation_type, from_id, to_id from relations)
       select 'parallel:' || relation_type as relation_type, from_id, to_id, count(*) as n from (select relation_type, from_id, to_id from e union all select relation_type, to_id, from_id from e) group by all"""
)
def scan_parallels(s, d):
    e = t(s, d, "relations").select("source_path", "relation_type", "from_id", "to_id").distinct()
    kinds = e.groupBy("source_path", "from_id", "relation_type").agg(F.sort_array(F.collect_set("to_id")).alias("to"))
    kinds = kinds.groupBy("source_path", "from_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation_type", "to")))).alias("kinds"))
    f = rendered(kinds, F.col("source_path"), F.concat(js(F.col("from_id")), F.lit(": "), F.to_json("kinds")), ["from_id"], "{", "}", ", ")
    return S.parse(f, P.parallels_json()).groupBy("relation_type", "from_id", "to_id").agg(F.count("*").alias("n"))


@query("select work_id, title, count(*) as n from works where work_id <> '' group by work_id, title")
def scan_extra_info(s, d):
    w = t(s, d, "works")
    item = F.to_json(F.struct(F.col("work_id").alias("uid"), F.col("title").alias("acronym"), "metadata_json"), {"ignoreNullFields": "false"})
    f = rendered(w, F.col("corpus"), item, ["work_id", "source_path", "ingested_at"], "[", "]", ", ")
    return S.parse(f, P.extra_info_json).groupBy("work_id", "title").agg(F.count("*").alias("n"))


_BRIDGE = r"""
with s as (select from_id, regexp_replace(split_part(to_id, ':', 1), 'n0', 'n') || ':' || split_part(to_id, ':', 2) as to_id from relations),
 b as (select distinct from_id, upper(split_part(to_id, ':', 1)) as w, split_part(to_id, ':', 2) as r from s where regexp_full_match(split_part(to_id, ':', 1), '(?i)[a-z]{1,4}\d{1,3}n\d{4,5}') and regexp_full_match(split_part(to_id, ':', 2), '(?i)\d{3,4}[a-c]\d{1,2}(\.\.\d{3,4}[a-c]\d{1,2})?')),
 l as (select from_id, w, unnest(string_split(r, '..')) as x from b),
 k as (select from_id, regexp_extract(w, '^([A-Z]+)(\d+)N(\d+)$', 1) || lpad(regexp_extract(w, '^([A-Z]+)(\d+)N(\d+)$', 2), cast(greatest(2, length(regexp_extract(w, '^([A-Z]+)(\d+)N(\d+)$', 2))) as int), '0') || 'n' || regexp_extract(w, '^([A-Z]+)(\d+)N(\d+)$', 3) as w,
   lpad(regexp_extract(x, '^(\d+)', 1), 4, '0') || lower(regexp_extract(x, '([a-cA-C])', 1)) || lpad(regexp_extract(x, '(\d+)$', 1), 2, '0') as x from l),
 g as (select from_id, count(distinct w) as n_works, min(x) as lo, max(x) as hi from k group by from_id)
"""


@query(
    _BRIDGE
    + """select 'bridge:work' as relation_type, from_id, w as to_id from (select distinct from_id, w from k)
         union all select 'bridge:line_range', g.from_id, k.w || ':' || lo || '..' || hi from g join (select distinct from_id, w from k) k on k.from_id = g.from_id where n_works = 1"""
)
def scan_bridge_html(s, d):
    work, lines = r"(?i)^[a-z]{1,4}\d{1,3}n\d{4,5}$", r"(?i)^\d{3,4}[a-c]\d{1,2}(\.\.\d{3,4}[a-c]\d{1,2})?$"
    b = t(s, d, "relations").select("from_id", F.regexp_replace(F.split_part("to_id", F.lit(":"), F.lit(1)), "n0", "n").alias("w"), F.split_part("to_id", F.lit(":"), F.lit(2)).alias("r")).distinct()
    b = b.filter(F.col("w").rlike(work) & F.col("r").rlike(lines))
    anchors = F.array_join(F.transform(F.split("r", r"\.\."), lambda x: F.concat(F.lit('<a id="t'), x, F.lit('"></a>'))), "")
    item = F.concat(F.lit('<p><a href="https://corpus.example/'), "w", F.lit('">x</a>'), anchors, F.lit("</p>"))
    head = F.concat(F.lit('<article id="'), xml(F.col("from_id")), F.lit('">'))
    f = rendered(b, F.col("from_id"), item, ["w", "r"], head, "</article>")
    return S.parse(f, P.bridge_html("corpus.example")).select("relation_type", "from_id", "to_id")


def _squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


@query(
    f"""with r as (select corpus, source_path, id, sequence_no, {_squeezed("raw_text")} as txt from records)
        select replace(source_path, '/', '.') || ':' || id as segment_id, txt as raw_text, row_number() over (partition by corpus, source_path order by sequence_no, id) - 1 as sequence_no from r where txt <> ''"""
)
def scan_line_tei(s, d):
    """Lines between milestones; the note that each begins with is left out."""
    r = t(s, d, "records")
    item = F.concat(F.lit('<lb n="'), F.col("id").cast("string"), F.lit('"/><note>left out</note>'), xml(F.col("raw_text")))
    head = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="'), xml(_flat()), F.lit('"><text><body><p>'))
    f = rendered(r, F.concat("corpus", F.lit("/"), "source_path"), item, _ORDER, head, "</p></body></text></TEI>")
    return S.parse(f, P.line_tei).filter("kind = 'record'").select("segment_id", "raw_text", "sequence_no")


@query(
    f"""select replace(source_path, '/', '.') as work_id, replace(source_path, '/', '.') || ':' || id as segment_id, {_squeezed("coalesce(lemma, '')")} as lemma,
        coalesce(nullif({_squeezed("case when reading = '[omission]' then '' else reading end")}, ''), '[omission]') as reading, witnesses, 'apparatus' as variant_type from variants"""
)
def scan_apparatus(s, d):
    v = t(s, d, "variants")
    wit = F.when(F.col("witnesses").isNull(), "").otherwise(F.concat(F.lit(' wit="'), xml(F.col("witnesses")), F.lit('"')))
    reading = F.when(F.col("reading") == "[omission]", "").otherwise(xml(F.col("reading")))
    item = F.concat(F.lit('<app from="#'), F.col("id").cast("string"), F.lit('"><lem>'), xml(F.coalesce("lemma", F.lit(""))), F.lit("</lem><rdg"), wit, F.lit(">"), reading, F.lit("</rdg></app>"))
    head = F.concat(F.lit('<TEI xml:id="'), xml(_flat()), F.lit('"><text><body/><back>'))
    f = rendered(v, F.concat("corpus", F.lit("/"), "source_path"), item, ["id"], head, "</back></text></TEI>")
    return S.parse(f, P.line_tei).filter("kind = 'variant'").select("work_id", "segment_id", "lemma", "reading", "witnesses", "variant_type")


_LINES = """
with l as (select corpus, source_path, 'A1n' || lpad(cast(dense_rank() over (order by corpus, source_path) as varchar), 6, '0') as w, 'p' || id as line, trim(regexp_replace(replace(raw_text, chr(10), ' '), '<[^>]+>|\\[[^\\]]+\\]', ' ', 'g')) as txt,
   row_number() over (partition by corpus, source_path order by sequence_no, id) - 1 as no, sequence_no, id from records)
"""


def _line_files(s: SparkSession, d: str) -> DataFrame:
    r = t(s, d, "records")
    paths = r.select("corpus", "source_path").distinct()
    from codexmill.operators.order import with_ordinal

    works = with_ordinal(paths, ["corpus", "source_path"], "_n").withColumn("_w", F.concat(F.lit("A1n"), F.lpad((F.col("_n") + 1).cast("string"), 6, "0")))
    r = r.join(works.select("corpus", "source_path", "_w"), ["corpus", "source_path"])
    item = F.concat("_w", F.lit("_pp"), F.col("id").cast("string"), F.lit("####"), F.replace("raw_text", F.lit("\n"), F.lit(" ")))
    return rendered(r, F.concat("corpus", F.lit("/"), "source_path"), item, _ORDER)


@query(_LINES + "select w as work_id, w || ':' || line as segment_id, txt as raw_text, no as sequence_no from l")
def scan_line_text(s, d):
    return S.parse(_line_files(s, d), P.line_text(chunked=False)).select("work_id", "segment_id", "raw_text", "sequence_no")


@query(
    _LINES
    + """, k as (select *, (row_number() over (partition by w order by no) - 1) // 300 as c from l where txt <> ''), g as (
       select w, c, count(*) as n, min(no) as first_no, max(no) as last_no, string_agg(txt, ' ' order by no) as raw_text from k group by w, c),
     e as (select w, c, raw_text, case when c = 0 then 0 else lag(ends) over (partition by w order by c) + 1 end as a, ends as b from (
       select g.*, coalesce(lead(first_no) over (partition by w order by c) - 1, (select max(no) from l where l.w = g.w)) as nxt, case when n = 300 then last_no else null end as full_at,
         case when n = 300 then last_no else (select max(no) from l where l.w = g.w) end as ends from g) x)
     select w as work_id, w || ':' || (select line from l where l.w = e.w and no = a) || '..' || (select line from l where l.w = e.w and no = b) as segment_id, raw_text, c as sequence_no from e"""
)
def scan_line_runs(s, d):
    return S.parse(_line_files(s, d), P.line_text()).select("work_id", "segment_id", "raw_text", "sequence_no")


_PASSAGES = f"""
with r as (select corpus, source_path, id, sequence_no, {_squeezed("raw_text")} as txt, {_squeezed("coalesce(title, '')")} as note from records),
 u as (select *, row_number() over (partition by corpus, source_path order by sequence_no, id) - 1 as no from r where txt <> '')
"""


@query(
    _PASSAGES
    + """select 'u' || id as segment_id, txt as raw_text, 'translation_main' as text_role, 'toh' as rel, no as sequence_no, replace(source_path, '/', '.') as work_id from u
       union all select 'u' || id || ':synthetic-note:' || no || ':1', note, 'translation_note', 'u' || id, no, replace(source_path, '/', '.') from u where note <> ''"""
)
def scan_passage_tei(s, d):
    """Paragraphs with a note in their middle, where the record has a title."""
    r = t(s, d, "records")
    half = F.floor(F.length("raw_text") / 2).cast("int")
    a, b = F.substring("raw_text", F.lit(1), half), F.substring("raw_text", half + 1, F.length("raw_text"))
    note = F.concat(F.lit("<note>"), xml(F.coalesce("title", F.lit(""))), F.lit("</note>"))
    item = F.concat(F.lit('<milestone xml:id="m"/><p xml:id="u'), F.col("id").cast("string"), F.lit('">'), xml(a), note, xml(b), F.lit("</p>"))
    head = F.concat(F.lit('<TEI><teiHeader><fileDesc><publicationStmt><idno xml:id="'), xml(_flat()), F.lit('"/></publicationStmt><sourceDesc><bibl key="toh"/></sourceDesc></fileDesc></teiHeader><text><body>'))
    f = rendered(r, F.concat("corpus", F.lit("/"), "source_path"), item, _ORDER, head, "</body></text></TEI>")
    return S.parse(f, P.passage_tei).filter("kind = 'record'").select("segment_id", "raw_text", "text_role", F.array_join("relation_ids", "|").alias("rel"), "sequence_no", "work_id")


@query(_PASSAGES + "select 'note_of' as relation_type, 'u' || id || ':synthetic-note:' || no || ':1' as from_id, 'u' || id as to_id from u where note <> ''")
def scan_passage_notes(s, d):
    r = t(s, d, "records")
    item = F.concat(F.lit('<p xml:id="u'), F.col("id").cast("string"), F.lit('">'), xml(F.col("raw_text")), F.lit("<note>"), xml(F.coalesce("title", F.lit(""))), F.lit("</note></p>"))
    f = rendered(r, F.concat("corpus", F.lit("/"), "source_path"), item, _ORDER, "<TEI><text><body>", "</body></text></TEI>")
    return S.parse(f, P.passage_tei).filter("kind = 'relation'").select("relation_type", "from_id", "to_id")


@query(
    f"""select 'rdf:partOf' as relation_type, work_id as from_id, corpus as to_id, cast(null as varchar) as title from works where work_id <> ''
        union all select 'work', work_id, language, {_squeezed("title")} from works where work_id <> '' and {_squeezed("title")} <> ''"""
)
def scan_rdf(s, d):
    w = t(s, d, "works").filter("work_id <> ''")
    lang = F.when(F.col("language").isNull(), "").otherwise(F.concat(F.lit(' xml:lang="'), "language", F.lit('"')))
    label = F.concat(F.lit("<s:prefLabel"), lang, F.lit(">"), xml(F.coalesce("title", F.lit(""))), F.lit("</s:prefLabel>"))
    item = F.concat(F.lit('<rdf:Description rdf:about="urn:x/'), xml(F.col("work_id")), F.lit('">'), label, F.lit('<s:partOf rdf:resource="urn:x/'), xml(F.col("corpus")), F.lit('"/><s:other rdf:resource="urn:x/y"/></rdf:Description>'))
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="urn:s">'
    rows = S.parse(rendered(w, F.col("source_path"), item, ["work_id", "ingested_at"], head, "</rdf:RDF>"), P.rdf_xml())
    kind = F.coalesce("relation_type", "kind").alias("relation_type")
    return rows.select(kind, F.coalesce("from_id", "work_id").alias("from_id"), F.coalesce("to_id", "language").alias("to_id"), "title")


@query(
    """with u as (select replace(source_path, '/', '.') as w, id, raw_text, title, witness, segment_id, row_number() over (partition by corpus, source_path order by sequence_no, id) as no from records)
       select w || ':tu:' || no || ':bo' as segment_id, 'bo' as language, raw_text, w || ':tu:' || no || '|' || coalesce(segment_id, w || ':tu:' || no) || '|' as rel, witness, cast(null as varchar) as to_id from u
       union all select w || ':tu:' || no || ':en', 'en', coalesce(title, ''), w || ':tu:' || no || '|' || coalesce(segment_id, w || ':tu:' || no) || '|', witness, null from u
       union all select w || ':tu:' || no || ':bo', null, null, null, null, w || ':tu:' || no || ':en' from u"""
)
def scan_translation_memory(s, d):
    r = t(s, d, "records")
    item = F.to_json(F.struct(F.col("raw_text").alias("tibetan"), F.col("title").alias("english"), F.col("segment_id").alias("passage-xmlId"), F.col("witness").alias("creation_method")))
    head = F.concat(F.lit('{"text-id": '), js(_flat()), F.lit(', "tus": ['))
    rows = A.translation_memory(rendered(r, F.concat("corpus", F.lit("/"), "source_path"), item, _ORDER, head, "]}", ","))
    return rows.select(F.coalesce("segment_id", "from_id").alias("segment_id"), "language", "raw_text", F.array_join("relation_ids", "|").alias("rel"), "witness", "to_id")


_ALIGNED = """
with l as (select replace(source_path, '/', '.') as w, coalesce(language, 'und') as language, corpus, source_path, replace(raw_text, chr(10), ' ') as raw_text,
    row_number() over (partition by corpus, source_path, coalesce(language, 'und') order by sequence_no, id) as no from records)
"""


def _aligned(s: SparkSession, d: str) -> DataFrame:
    r = t(s, d, "records")
    path = F.concat(F.lit("texts/"), _flat(), F.lit("-"), _lang(), F.lit(".txt"))
    lines = A.lines_of(rendered(r, path, F.replace("raw_text", F.lit("\n"), F.lit(" ")), _ORDER, "", "\n"))
    catalog = r.select(F.concat(_flat(), F.lit("-"), _lang(), F.lit(".txt")).alias("file"), F.col("corpus").alias("title"), F.lit("mill").alias("source")).filter("title <> 'millpond'").distinct()
    return A.aligned_records(lines, catalog)


@query(_ALIGNED + "select w || ':line:' || no || ':' || language as segment_id, raw_text, language, no - 1 as sequence_no, nullif(corpus, 'millpond') as title, case when corpus <> 'millpond' then 'mill' end as witness from l")
def scan_aligned_lines(s, d):
    return _aligned(s, d).select("segment_id", "raw_text", "language", "sequence_no", "title", "witness")


@query(_ALIGNED + ", m as (select w || ':line:' || no as g, min(w || ':line:' || no || ':' || language) as first from l group by w, no) select first as from_id, w || ':line:' || no || ':' || language as to_id from l join m on m.g = w || ':line:' || no where first <> w || ':line:' || no || ':' || language")
def scan_alignments(s, d):
    return A.alignments(_aligned(s, d)).select("from_id", "to_id")


@query("select coalesce(nullif(work_id, ''), split_part(replace(source_path, '/', '.'), '.json', 1)) as work_id, coalesce(work_id, '') || ':' || id as segment_id, raw_text, row_number() over (partition by corpus, source_path order by sequence_no, id) - 1 as sequence_no from records")
def scan_segmented_json(s, d):
    """Files of every second corpus are compressed."""

    @F.pandas_udf("binary")
    def gz(content: pd.Series) -> pd.Series:
        import gzip

        return content.map(lambda c: gzip.compress(bytes(c), mtime=0))

    r = t(s, d, "records")
    key = F.concat(F.coalesce("work_id", F.lit("")), F.lit(":"), F.col("id").cast("string"))
    f = rendered(r, F.concat("corpus", F.lit("/"), _flat(), F.lit(".json")), F.concat(js(key), F.lit(": "), js(F.col("raw_text"))), _ORDER, "{", "}", ", ")
    packed = F.col("source_path") < "n"
    f = f.filter(packed).select(F.concat("source_path", F.lit(".gz")).alias("source_path"), gz("content").alias("content")).unionByName(f.filter(~packed))
    return S.parse(f, P.segmented_json("lzh")).select("work_id", "segment_id", "raw_text", "sequence_no")


@query(
    """with p as (select replace(source_path, '/', '.') as title, id, trim(raw_text, ' ' || chr(10)) as raw_text, corpus, source_path, sequence_no from records)
       select title, title || ':page:' || id as segment_id, raw_text, row_number() over (partition by corpus, source_path order by sequence_no, id) - 1 as sequence_no from p where raw_text <> ''"""
)
def scan_paged_text(s, d):
    r = t(s, d, "records")
    item = F.concat(F.lit("page "), F.col("id").cast("string"), F.lit("\n====\n"), "raw_text")
    f = rendered(r, F.concat("corpus", F.lit("/"), "source_path"), item, _ORDER, F.concat(_flat(), F.lit("\nbefore the first page\n")))
    return S.parse(f, P.paged_text("pli")).select("title", "segment_id", F.btrim("raw_text", F.lit(" \n")).alias("raw_text"), "sequence_no")


def _lemma_files(s: SparkSession, d: str) -> DataFrame:
    lem = t(s, d, "lemmas")
    tok = F.to_json(F.struct(F.col("surface").alias("word"), "lemma", "pos", F.lit("x").alias("case")), {"ignoreNullFields": "false"})
    seg = lem.groupBy("corpus", "source_path", "segment_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", tok.alias("t")))), lambda x: x["t"]), ",").alias("toks"))
    item = F.concat(F.lit('{"id": '), js(F.col("segment_id")), F.lit(', "pali": "x", "tokens": ['), "toks", F.lit("]}"))
    return rendered(seg, F.concat("corpus", F.lit("/"), "source_path"), item, ["segment_id"], F.concat(F.lit('{"id": '), js(F.col("source_path")), F.lit(', "segments": [')), "]}", ",")


@query("""select source_path as work_id, segment_id, surface, lemma, pos, '{"case": "x"}' as morphology_json, count(*) as n from lemmas where surface <> '' and lemma <> '' group by all""")
def scan_lemma_json(s, d):
    rows = S.parse(_lemma_files(s, d), P.lemma_json()).filter("kind = 'lemma'")
    return rows.groupBy("work_id", "segment_id", "surface", "lemma", "pos", "morphology_json").agg(F.count("*").alias("n"))


@query("select source_path as work_id, segment_id, string_agg(lemma, ' ' order by id) as lemma_text from lemmas group by corpus, source_path, segment_id")
def scan_lemma_records(s, d):
    return S.parse(_lemma_files(s, d), P.lemma_json()).filter("kind = 'record'").select("work_id", "segment_id", "lemma_text")


@query("select lower(nfc_normalize(surface)) as surface, lower(nfc_normalize(lemma)) as lemma, pos, min(corpus || '/' || source_path) as source_path from lemmas where surface <> '' and lemma <> '' group by 1, 2, 3")
def scan_lexicon(s, d):
    rows = S.parse(_lemma_files(s, d), P.lemma_json(records=False)).filter("kind = 'lemma'")
    return A.lexicon(rows).select("surface", "lemma", "pos", "source_path")


@query("select source_path as work_id, source_path || ':token:' || id as segment_id, reading, variant_type, confidence, notes from variants where reading <> ''")
def scan_critical_json(s, d):
    v = t(s, d, "variants")
    item = F.to_json(F.struct(F.col("id").alias("position"), F.col("reading").alias("selected"), F.col("variant_type").alias("type"), "confidence", "notes"))
    f = rendered(v, F.concat("corpus", F.lit("/"), "source_path"), item, ["id"], F.concat(F.lit('{"id": '), js(F.col("source_path")), F.lit(', "apparatus": [')), "]}", ",")
    return S.parse(f, P.critical_json).select("work_id", "segment_id", "reading", "variant_type", "confidence", "notes")


# --------------------------------------------------------------- places in files


def _selectors(r: DataFrame, path: Column, segment: Column) -> DataFrame:
    quote = F.when(F.col("id") % 3 == 0, F.substring("raw_text", F.lit(1), F.lit(12)))
    cols = [F.col("id").cast("string").alias("evidence_id"), path.alias("source_path"), F.lit(None).cast("string").alias("work_id"), segment.alias("segment_id"), F.lit(None).cast("long").alias("sequence_no")]
    return r.select(*cols, quote.alias("quotation"))


@query("select id, case when regexp_matches(raw_text, '[^\\s\\p{Z}]') and not regexp_matches(raw_text, '[\"\\\\\\n<>&]') then raw_text end as excerpt, not regexp_matches(raw_text, '[^\\s\\p{Z}]') or regexp_matches(raw_text, '[\"\\\\\\n<>&]') as failed from records")
def spans_json(s, d):
    """The text of every record in its JSON file; texts with escapes have no place of their own."""
    r = t(s, d, "records")
    path, seg = F.concat("corpus", F.lit("/"), "source_path"), F.concat(F.lit("w:"), F.col("id").cast("string"))
    f = rendered(r, path, F.concat(js(seg), F.lit(": "), js(F.col("raw_text"))), _ORDER, "{", "}", ", ")
    got = V.resolve_spans(_selectors(r, path, seg), f.select("source_path", F.decode("content", "UTF-8").alias("content")), "json")
    return got.select(F.col("evidence_id").cast("long").alias("id"), "excerpt", F.col("error").isNotNull().alias("failed"))


@query("select id, replace(raw_text, chr(10), ' ') as excerpt from records where regexp_matches(raw_text, '[^\\s\\p{Z}]')")
def spans_line_tei(s, d):
    r = t(s, d, "records")
    path, flat = F.concat("corpus", F.lit("/"), "source_path"), F.replace("raw_text", F.lit("\n"), F.lit(" "))
    f = rendered(r, path, F.concat(F.lit('<lb n="'), F.col("id").cast("string"), F.lit('"/>'), xml(flat, quotes=False)), _ORDER, '<TEI xml:id="T"><text><body><p>', "</p></body></text></TEI>", "")
    got = V.resolve_spans(_selectors(r, path, F.concat(F.lit("T:"), F.col("id").cast("string"))).drop("quotation").withColumn("quotation", F.lit(None).cast("string")), f.select("source_path", F.decode("content", "UTF-8").alias("content")), "line_tei")
    return got.filter("error is null").select(F.col("evidence_id").cast("long").alias("id"), "excerpt")


@query("select id, replace(raw_text, chr(10), ' ') as excerpt from records where regexp_matches(raw_text, '[^\\s\\p{Z}]')")
def spans_passage_tei(s, d):
    r = t(s, d, "records")
    path, flat = F.concat("corpus", F.lit("/"), "source_path"), F.replace("raw_text", F.lit("\n"), F.lit(" "))
    f = rendered(r, path, F.concat(F.lit('<p xml:id="u'), F.col("id").cast("string"), F.lit('">'), xml(flat, quotes=False), F.lit("<note>n</note></p>")), _ORDER, "<TEI><text><body>", "</body></text></TEI>", "")
    got = V.resolve_spans(_selectors(r, path, F.concat(F.lit("u"), F.col("id").cast("string"))).drop("quotation").withColumn("quotation", F.lit(None).cast("string")), f.select("source_path", F.decode("content", "UTF-8").alias("content")), "passage_tei")
    return got.filter("error is null").select(F.col("evidence_id").cast("long").alias("id"), "excerpt")
