"""Checking quotations and evidence against their sources, in batch."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.functions import ids as I
from codexmill.functions import text as X


def _joins(c: str) -> bool:
    """Whether a character belongs to a word that a quotation must not cut (CJK has no such words)."""
    cp = ord(c)
    # The narrow CJK ranges.
    if 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or 0x20000 <= cp <= 0x2FA1F:
        return False
    return c.isalnum() or unicodedata.category(c)[0] == "M"


def _one_word(left: str, right: str) -> bool:
    """Whether a word runs on over the border between two texts."""
    return bool(left and right) and _joins(left[-1]) and _joins(right[0])


def stands_in(source: str, quotation: str) -> bool:
    """Whether the quotation stands somewhere in the source without cutting a word at either side."""
    between = source.split(quotation)
    last = len(between) - 1
    for i in range(last):
        # What stands beside this place: the text between, or the quotation again where two follow each other.
        before, after = between[i] or (quotation if i else ""), between[i + 1] or (quotation if i + 1 < last else "")
        if not _one_word(before, quotation) and not _one_word(quotation, after):
            return True
    return False


def quote_status_of(quotation: str | None, source: str | None) -> str:
    if not quotation or not source or not quotation.strip() or not source.strip():
        return "UNVERIFIED"
    if stands_in(source, quotation):
        return "VERIFIED_EXACT"
    return "VERIFIED_NORMALIZED" if stands_in(X.quote_safe_text(source), X.quote_safe_text(quotation)) else "QUOTE_MISMATCH"


@F.pandas_udf(T.StringType())
def quote_status(quotation: pd.Series, source: pd.Series) -> pd.Series:
    """VERIFIED_EXACT, VERIFIED_NORMALIZED, QUOTE_MISMATCH or UNVERIFIED (blank)."""
    return pd.Series([quote_status_of(q, s) for q, s in zip(quotation, source)], dtype=object)


def verify_quotes(quotes: DataFrame, sources: DataFrame, key: str = "id", text: str = "raw_text") -> DataFrame:
    """quotes (key, quotation, ...) with ``status`` against the source of that key; no source: UNVERIFIED."""
    s = sources.select(F.col(key), F.col(text).alias("_source"))
    return quotes.join(s, key, "left").withColumn("status", quote_status("quotation", "_source")).drop("_source")


def range_ok(content: Column, span: Column) -> Column:
    """Whether an array [a, b] is a range of the content: 0 <= a < b <= length."""
    a, b = F.try_element_at(span, F.lit(1)), F.try_element_at(span, F.lit(2))
    return F.coalesce((F.size(span) == 2) & (a >= 0) & (a < b) & (b <= F.length(content)), F.lit(False))


def contains_range(outer: Column, inner: Column) -> Column:
    e = F.try_element_at
    return (e(outer, F.lit(1)) <= e(inner, F.lit(1))) & (e(inner, F.lit(2)) <= e(outer, F.lit(2)))


def _check(expected: Column, observed: Column) -> Column:
    return F.when(observed.isNull(), "UNVERIFIED").when(expected.eqNullSafe(observed), "PASS").otherwise("FAIL")


def _flag(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")


def _wide(df: DataFrame, prefix: str, fields: dict[str, str]) -> DataFrame:
    """The fields under a prefix; those that the frame does not have are null."""
    have = set(df.columns)
    return df.select("evidence_id", *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(prefix + c) for c, kind in fields.items()], F.lit(True).alias(f"{prefix}here"))


LOCATION = {"work_id": "string", "segment_id": "string", "sequence_no": "long"}
#: What a reader of sources reports.
READ = {
    "content": "string", "repository": "string", "source_sha": "string", "source_path": "string", "blob_sha": "string", "excerpt_range": "array<int>", "context_range": "array<int>", **LOCATION,
}
#: What a candidate may say beyond what it must.
MAY = {"run_id": "string", "language": "string", "witness": "string", "indexed_source_path": "string", "blob_sha": "string"}


def contract_class(path: Column, evidence_class: Column, of_translations: str = "authoritative_structured") -> Column:
    """The evidence class that the contract of a corpus sets for a path: translations and comments are never canonical."""
    first = F.split_part(F.regexp_replace(path, "^/+", ""), F.lit("/"), F.lit(1))
    return F.when(first.isin("translation", "comment"), of_translations).otherwise(evidence_class)


def evidence_candidates(records: DataFrame, sources: DataFrame, quotations: DataFrame | None = None) -> DataFrame:
    """Records as candidates of evidence, none of which is verified by being indexed.

    sources (one row a corpus): corpus, repo_path, repository. A path outside the folder of its
    repository, or a corpus without one, leaves source_path or repository null, which no gate
    lets pass. quotations: id, quotation.
    """
    s = sources.select("corpus", "repo_path", "repository")
    j = records.join(s, "corpus", "left")
    head = F.concat(F.col("repo_path"), F.lit("/"))
    inside = F.col("source_path").startswith(head) & (F.length("source_path") > F.length(head))
    j = j.withColumn("indexed_source_path", F.col("source_path")).withColumn("source_path", F.when(inside, F.substring(F.col("source_path"), F.length(head) + 1, F.length("source_path"))))
    names = ("corpus", "repository", "source_sha", "source_path", "work_id", "segment_id", "sequence_no", "language", "witness", "evidence_class", "text_role")
    fixed = [F.col(c) for c in names]
    j = j.join(quotations.select("id", "quotation"), "id", "left") if quotations is not None else j.withColumn("quotation", F.lit(None).cast("string"))
    return j.select("id", I.evidence_id(F.col("id"), *fixed, names=["id", *names]).alias("evidence_id"), *names, "indexed_source_path", F.col("raw_text").alias("indexed_text"), "quotation", F.lit("CANDIDATE").alias("state"))


def evidence_checks(candidates: DataFrame, contract: DataFrame, opened: DataFrame, independent: DataFrame | None = None, use: str = "textual", mode: str = "quick") -> DataFrame:
    """candidates with ``checks`` (name -> PASS, FAIL, UNVERIFIED or NOT_APPLICABLE), ``gate``, ``quote_status`` and ``evidence``.

    candidates: evidence_id, corpus, repository, source_sha, source_path, work_id,
    segment_id, sequence_no, evidence_class, text_role, quotation, and those of ``MAY``.
    contract (one row a corpus): corpus, repo_path, repository, source_sha,
    evidence_class, and optionally blob_required. opened and independent (two readings
    of the source): evidence_id and those of ``READ``; what a frame lacks counts as not
    reported. Any FAIL rejects; any UNVERIFIED that is required leaves it unverified.
    ``evidence`` (before, text, after) is given only where the gate is VERIFIED.
    """
    c = candidates
    k = contract if "blob_required" in contract.columns else contract.withColumn("blob_required", F.lit(False))
    k = k.select("corpus", *[F.col(x).alias(f"c_{x}") for x in ("repo_path", "repository", "source_sha", "evidence_class", "blob_required")])
    j = c.join(k, "corpus", "left").join(_wide(opened, "o_", READ), "evidence_id", "left")
    none = opened.filter("false") if independent is None else independent
    j = j.join(_wide(none, "i_", READ), "evidence_id", "left")
    for x, kind in MAY.items():
        if x not in c.columns:
            j = j.withColumn(x, F.lit(None).cast(kind))
    col, relation = F.col, use == "relationship"
    text = lambda x: F.btrim(F.coalesce(F.col(x), F.lit(""))) != ""
    unless = lambda off, status: F.when(off, "NOT_APPLICABLE").otherwise(status)
    # An independent reading counts if the candidate asked for the pinned source.
    anchored = text("i_content") & (col("repository") == col("c_repository")) & (col("source_sha") == col("c_source_sha")) & I.valid_path(col("source_path"))
    anchored = F.coalesce(anchored, F.lit(False))
    alone = lambda status: unless(~anchored, status)
    sequence = col("sequence_no").isNull() | (col("sequence_no") >= 0)
    places = [col(x).isNull() | text(x) for x in ("work_id", "segment_id", "language", "witness")]
    good = lambda who, y: F.when(range_ok(col(f"{who}_content"), col(f"{who}_{y}")), col(f"{who}_{y}"))
    excerpt, context = good("o", "excerpt_range"), good("o", "context_range")
    actual = I.git_blob_sha(col("o_content"))
    no_blob = F.when(F.coalesce(col("c_blob_required"), F.lit(False)), "UNVERIFIED").otherwise("NOT_APPLICABLE")
    # The names of the checks and of their results.
    checks = {
        "required_provenance": _flag(text("evidence_id") & text("corpus") & text("repository") & text("evidence_class") & text("text_role")),
        "source_sha_format": _flag(I.is_sha(col("source_sha"))),
        "source_path_format": _flag(I.valid_path(col("source_path"))),
        "mode": _flag(F.lit(mode in ("quick", "research"))),
        "run_id": _flag(text("run_id") if mode == "research" else F.lit(True)),
        "use": _flag(F.lit(use in ("textual", "relationship"))),
        "text_role_known": _flag(text("text_role") & (col("text_role") != "unspecified")),
        "location_format": _flag(sequence & places[0] & places[1] & places[2] & places[3]),
        "corpus_mapping": _flag(I.valid_path(col("c_repo_path"))),
        "repository_mapping": _check(col("c_repository"), col("repository")),
        "evidence_class": _check(contract_class(col("source_path"), col("c_evidence_class")), col("evidence_class")),
        "pinned_source_sha": F.when(~F.coalesce(I.is_sha(col("c_source_sha")), F.lit(False)), "UNVERIFIED").otherwise(_check(col("c_source_sha"), col("source_sha"))),
        "indexed_source_path": unless(col("indexed_source_path").isNull(), _flag(col("indexed_source_path") == F.concat("c_repo_path", F.lit("/"), "source_path"))),
        "textual_source": F.when(F.lit(not relation) & (col("evidence_class") == "metadata_relationship"), "FAIL").otherwise("PASS"),
        "source_opened": F.when(F.length("o_content") > 0, "PASS").otherwise("UNVERIFIED"),
        **{f"opened_{x}": _check(col(x), col(f"o_{x}")) for x in ("repository", "source_sha", "source_path")},
        **{f"location_{x}": F.when(col("o_here").isNull(), "UNVERIFIED").when(col(x).isNull() & col(f"o_{x}").isNull(), "NOT_APPLICABLE").otherwise(_flag(col(x).eqNullSafe(col(f"o_{x}")))) for x in LOCATION},
        "independent_source": F.when(anchored, "PASS").otherwise("UNVERIFIED"),
        **{f"independent_{x}": alone(_check(col(x), col(f"i_{x}"))) for x in ("repository", "source_sha", "source_path")},
        "independent_content": alone(_check(col("i_content"), col("o_content"))),
        "independent_blob": alone(F.when(col("i_blob_sha").isNull(), no_blob).otherwise(_flag(I.git_blob_sha(col("i_content")) == col("i_blob_sha")))),
        **{f"independent_location_{x}": alone(F.when(col("o_here").isNull(), "UNVERIFIED").otherwise(_flag(col(f"i_{x}").eqNullSafe(col(f"o_{x}"))))) for x in LOCATION},
        **{f"independent_{x}": alone(F.when(good("i", x).isNull() | good("o", x).isNull(), "UNVERIFIED").otherwise(_flag(good("i", x) == good("o", x)))) for x in ("excerpt_range", "context_range")},
        "expected_blob": F.when(col("blob_sha").isNull() | col("o_content").isNull(), "NOT_APPLICABLE").otherwise(_flag(col("blob_sha") == actual)),
        "opened_blob": F.when(col("o_content").isNull(), "NOT_APPLICABLE").when(col("o_blob_sha").isNull(), no_blob).otherwise(_flag(col("o_blob_sha") == actual)),
        **{x: F.when(col("o_content").isNull(), "NOT_APPLICABLE").when(col(f"o_{x}").isNull(), "UNVERIFIED").otherwise(_flag(good("o", x).isNotNull())) for x in ("excerpt_range", "context_range")},
        "context_contains_excerpt": unless(excerpt.isNull() | context.isNull(), _flag(contains_range(context, excerpt))),
        "quotation": F.when(F.lit(relation) & col("quotation").isNull(), "NOT_APPLICABLE").when(col("_q") == "QUOTE_MISMATCH", "FAIL").when(col("_q") == "UNVERIFIED", "UNVERIFIED").otherwise("PASS"),
    }
    part = lambda a, b: F.substring(col("o_content"), a + 1, b - a)
    at = lambda r, i: F.try_element_at(r, F.lit(i))
    j = j.withColumn("_q", quote_status("quotation", F.when(excerpt.isNotNull(), part(at(excerpt, 1), at(excerpt, 2)))))
    j = j.withColumn("checks", F.create_map(*[x for n, v in checks.items() for x in (F.lit(n), v)]))
    vals = F.map_values("checks")
    gate = F.when(F.array_contains(vals, "FAIL"), "REJECTED").when(F.array_contains(vals, "UNVERIFIED"), "UNVERIFIED").otherwise("VERIFIED")
    shown = F.struct(part(at(context, 1), at(excerpt, 1)).alias("before"), part(at(excerpt, 1), at(excerpt, 2)).alias("text"), part(at(excerpt, 2), at(context, 2)).alias("after"))
    j = j.withColumn("gate", gate)
    return j.select(*c.columns, F.col("_q").alias("quote_status"), "checks", "gate", F.when(col("gate") == "VERIFIED", shown).alias("evidence"))


def verified_hits(hits: DataFrame, spans: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """Hits of a search with the excerpt found in their source and the status of its quotation.

    hits: query_id, id, ... (``search``). spans: evidence_id (the record id as text),
    excerpt, error (``sources.spans.resolve_spans``). quotes: id, quotation; without, the
    excerpt itself is what is quoted. A hit whose source gives no excerpt stays UNVERIFIED.
    """
    s = spans.select(F.col("evidence_id").cast("long").alias("id"), "excerpt", "error")
    j = hits.join(s, "id", "left")
    j = j.join(quotes.select("id", "quotation"), "id", "left") if quotes is not None else j.withColumn("quotation", F.col("excerpt"))
    return j.withColumn("quote_status", quote_status("quotation", "excerpt"))


#: Where a text is: its source, and the place in it.
PLACE = ("corpus", "source_sha", "source_path", "work_id", "segment_id", "sequence_no")


def bindings(hits: DataFrame, evidence: DataFrame, key: str = "evidence_id", fields: tuple[str, ...] = PLACE) -> DataFrame:
    """(key, differs, bound): whether a hit is at the very place of the evidence it is offered for.

    differs: the fields that are not the same (two nulls are). A hit without evidence differs in all;
    one that names neither segment nor sequence is nowhere in particular, and not bound.
    """
    e = evidence.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    j = hits.join(e, F.col(key) == F.col("_k"), "left")
    off = F.array_compact(F.array(*[F.when(F.col("_k").isNull() | ~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fields]))
    precise = F.coalesce("segment_id", F.col("sequence_no").cast("string")).isNotNull()
    return j.select(key, off.alias("differs"), ((F.size(off) == 0) & precise).alias("bound"))


def output_items(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """items (item_id, kind, value, evidence_id) with ``status``: what a text says about a source, checked against it.

    evidence: evidence_id, text, title, work_id, segment_id. TITLE: the title to the letter;
    IDENTIFIER: the work or the segment; QUOTE: as ``quote_status``. UNVERIFIED: no such
    evidence, nothing said, or an unknown kind.
    """
    e = evidence.select("evidence_id", *[F.col(c).alias(f"_{c}") for c in ("text", "title", "work_id", "segment_id")])
    j = items.join(e.withColumn("_here", F.lit(True)), "evidence_id", "left").withColumn("_q", quote_status("value", "_text"))
    said = F.btrim(F.coalesce("value", F.lit(""))) != ""
    exact = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "VERIFIED_EXACT").otherwise("MISMATCH")
    same = F.when(F.col("kind") == "TITLE", exact(F.col("value") == F.col("_title"))).when(F.col("kind") == "IDENTIFIER", exact(F.coalesce(F.col("value") == F.col("_work_id"), F.lit(False)) | F.coalesce(F.col("value") == F.col("_segment_id"), F.lit(False))))
    quote = F.when(F.col("kind") == "QUOTE", F.when(F.col("_q") == "QUOTE_MISMATCH", "MISMATCH").otherwise(F.col("_q")))
    return j.select(*items.columns, F.when(F.col("_here").isNull() | ~said, "UNVERIFIED").otherwise(F.coalesce(same, quote, F.lit("UNVERIFIED"))).alias("status"))


FAMILY = ["repository", "source_sha", "source_path", "work_id", "witness"]


def source_families(evidence: DataFrame, group: str, key: str = "id", family: list[str] | None = None) -> DataFrame:
    """evidence with ``family``: the least key of the rows of its group that share source, work and witness.

    Equality of these columns is transitive, so families are a hash aggregate, not a search over pairs.
    """
    cols = [group, *(family or FAMILY)]
    least = evidence.groupBy(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(cols)]).agg(F.min(key).alias("family"))
    return evidence.join(least, [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(cols)]).select(*evidence.columns, "family")


def independent_sources(evidence: DataFrame, group: str, derived: DataFrame | None = None, key: str = "id", family: list[str] | None = None) -> DataFrame:
    """(group, n_items, n_families): items and families of sources.

    Families by equal columns are one hash aggregate. ``derived`` (key, from_key)
    merges families that depend on each other: each takes the least label among its
    neighbours and then its label's label, until none changes, so a chain of n
    families takes some log n rounds.
    """
    cols = family or FAMILY
    if derived is None:
        return evidence.groupBy(group).agg(F.count("*").alias("n_items"), F.count_distinct(F.struct(*[F.col(c) for c in cols])).alias("n_families"))
    from codexmill.session import spool

    fam = spool(source_families(evidence, group, key, cols).select(group, key, "family"), "families")
    of = fam.select(F.col(key).alias("_k"), F.col(group).alias("_g"), "family")
    a, b = of.toDF("_ka", "_ga", "fa"), of.toDF("_kb", "_gb", "fb")
    links = derived.join(a, derived[key] == a["_ka"]).join(b, F.col("from_key") == b["_kb"]).filter("_ga = _gb and fa <> fb").select("fa", "fb")
    links = spool(links.unionByName(links.select(F.col("fb").alias("fa"), F.col("fa").alias("fb"))).distinct(), "links")
    label = fam.select("family").distinct().withColumn("root", F.col("family"))
    while True:
        low = links.join(label.withColumnRenamed("family", "fb"), "fb").groupBy("fa").agg(F.min("root").alias("near"))
        new = label.join(low, label["family"] == low["fa"], "left").select("family", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        new = spool(new, "labels")
        up = new.select(F.col("family").alias("_f"), F.col("root").alias("_r"))
        new = spool(new.join(up, F.col("root") == F.col("_f")).select("family", "was", F.least("root", "_r").alias("root")), "labels")
        label = new.select("family", "root")
        if new.filter("root < was").isEmpty():
            break
    return fam.join(label, "family").groupBy(group).agg(F.count("*").alias("n_items"), F.count_distinct("root").alias("n_families"))




@F.pandas_udf(T.BooleanType())
def strict_json(s: pd.Series) -> pd.Series:
    """Whether a text is valid JSON in which no object repeats a key."""
    import json

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def ok(t: str | None) -> bool | None:
        if t is None:
            return None
        try:
            json.loads(t, object_pairs_hook=unique)
        except (ValueError, RecursionError):
            return False
        return True

    return pd.Series([ok(t) for t in s], dtype=object)
