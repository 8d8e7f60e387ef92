"""Core operators on small fixtures, against brute force where it is not obvious."""

import random
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from codexmill.operators import export as E
from codexmill.operators import ledger as G
from codexmill.operators import lookup as L
from codexmill.operators import order as O
from codexmill.operators import orphans as R
from codexmill.operators import pointers as P
from codexmill.operators import resolve as Z
from codexmill.operators import search as S
from codexmill.operators import tables as T
from codexmill.operators import verify as V

REC = "id long, corpus string, language string, collection_name string, work_id string, segment_id string, title string, raw_text string, norm_text string, folded_text string, compact_text string, lemma_text string, source_path string, source_sha string, evidence_class string, text_role string, witness string, relation_ids string, sequence_no long, ingested_at timestamp_ntz"


def rec(id, **k):
    base = dict(corpus="c", language="pli", collection_name=None, work_id="w", segment_id=f"w:{id}", title=None, raw_text="evaṃ me", norm_text="evaṃ me", folded_text="evam me", compact_text="evaṃme", lemma_text="", source_path="c/w.json", source_sha="a" * 40, evidence_class="canonical_root", text_role="root_text", witness=None, relation_ids="[]", sequence_no=id, ingested_at=D(2024, 1, 1))
    return (id, *{**base, **k}.values())


# ---------------------------------------------------------------- orphans


def orphans(spark, recs, works):
    w = spark.createDataFrame(works, "corpus string, work_id string, source_path string, ingested_at timestamp_ntz, deleted_at timestamp_ntz")
    return {(r.id, r.field, r.ref, r.status) for r in R.orphan_references(spark.createDataFrame(recs, REC), w).collect()}


def test_orphan_status(spark):
    works = [("c", "w", "p", D(2023, 1, 1), None), ("c", "late", "p", D(2025, 1, 1), None), ("c", "gone", "p", D(2022, 1, 1), D(2024, 1, 1)), ("d", "other", "p", D(2022, 1, 1), None)]
    recs = [
        rec(1), rec(2, work_id="late"), rec(3, work_id="gone"), rec(4, work_id="other"), rec(5, work_id=None), rec(6, work_id=""), rec(7, work_id="w "),
        rec(8, relation_ids='["other:1.2#a", "nope#x", "nope#x", "", null]'), rec(9, relation_ids="[broken"), rec(10, relation_ids='{"a": "nope"}'), rec(11, relation_ids=None), rec(12, relation_ids='"nope"'),
    ]
    assert orphans(spark, recs, works) == {(2, "work_id", "late", "late"), (3, "work_id", "gone", "deleted"), (4, "work_id", "other", "missing"), (7, "work_id", "w ", "missing"), (8, "relation_ids", "nope#x", "missing")}


def test_orphans_of_empty_tables(spark):
    assert orphans(spark, [], [("c", "w", "p", D(2023, 1, 1), None)]) == set()
    assert orphans(spark, [rec(1)], []) == {(1, "work_id", "w", "missing")}


@pytest.mark.parametrize("match", ["partial", "simple", "full"])
def test_match_semantics(spark, match):
    refs = spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, None, "y"), (4, None, None), (5, "b", "x")], "id int, k1 string, k2 string").withColumn("at", F.lit(D(2024, 1, 1)))
    tgt = spark.createDataFrame([("a", "x")], "t1 string, t2 string").withColumn("f", F.lit(D(2020, 1, 1))).withColumn("u", F.lit(None).cast("timestamp"))
    got = {r.id for r in R.find_orphans(refs, tgt, {"k1": "t1", "k2": "t2"}, "at", "f", "u", match).collect()}
    assert got == {"partial": {3, 5}, "simple": {5}, "full": {2, 3, 5}}[match]


def test_sweep_agrees_with_arrays(spark):
    rnd = random.Random(8)
    day = lambda: D(2024, 1, rnd.randrange(1, 29))
    refs = [(i, rnd.choice("ab") if rnd.random() < 0.8 else None, rnd.choice("xyz"), day() if rnd.random() < 0.95 else None) for i in range(400)]
    tgt = [(rnd.choice("ab"), rnd.choice("xy"), day() if rnd.random() < 0.9 else None, day() if rnd.random() < 0.8 else None) for _ in range(40)]
    r = spark.createDataFrame(refs, "id int, k1 string, k2 string, at timestamp_ntz")
    t = spark.createDataFrame(tgt, "t1 string, t2 string, f timestamp_ntz, u timestamp_ntz")
    run = lambda n: sorted((x.id, x.status) for x in R.find_orphans(r, t, {"k1": "t1", "k2": "t2"}, "at", "f", "u", max_spans=n).collect())
    want = []
    for i, a, b, at in refs:
        rows = [x for x in tgt if (a is None or x[0] == a) and x[1] == b]
        if not rows:
            want.append((i, "missing"))
        elif at and not any((x[2] is None or x[2] <= at) and (x[3] is None or x[3] > at) for x in rows):
            want.append((i, "late" if all(x[2] and x[2] > at for x in rows) else "deleted"))
    assert run(1000) == run(0) == sorted(want)


def test_orphans_keep_clashing_columns(spark):
    refs = spark.createDataFrame([(1, "q", "v")], "id int, k string, work_id string").withColumn("at", F.lit(None).cast("timestamp_ntz"))
    tgt = spark.createDataFrame([("z", "v2")], "k string, work_id string").withColumn("f", F.lit(D(2020, 1, 1)).cast("timestamp_ntz")).withColumn("u", F.lit(None).cast("timestamp_ntz"))
    assert [tuple(r) for r in R.find_orphans(refs, tgt, {"k": "k"}, "at", "f", "u").collect()] == [(1, "q", "v", None, "missing")]


# ---------------------------------------------------------------- order and lookups


def test_ordinals_and_running_totals(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abc"), rnd.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, v int")
    got = {r.id: (r.ordinal, r.running) for r in O.with_ordinal(df, ["g", "id"], total_of=F.col("v").cast("long")).collect()}
    total = 0
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        total += v
        assert got[i] == (n, total)


def test_context(spark):
    recs = [rec(i) for i in range(1, 6)] + [rec(6, work_id="x", source_path="c/x"), rec(7, work_id=None), rec(8, work_id=None)]
    got = {(r.id, r.offset): r.neighbour for r in L.context(spark.createDataFrame(recs, REC), 2).collect()}
    assert [got.get((3, k)) for k in (-2, -1, 1, 2)] == [1, 2, 4, 5] and (6, 1) not in got and got[7, 1] == 8
    one = spark.createDataFrame([(3,)], "id long")
    assert L.context(spark.createDataFrame(recs, REC), 1, one).count() == 2
    assert L.context(spark.createDataFrame(recs, REC), 0).count() == 0
    with pytest.raises(ValueError):
        L.context(spark.createDataFrame(recs, REC), -1)


def test_parallels_and_variants(spark):
    rel = spark.createDataFrame([(1, "p", "a", "b"), (2, "p", "a#1", "c"), (3, "p", "c", "a"), (4, "p", "ab", "x"), (5, "p", "a", "a")], "id long, relation_type string, from_id string, to_id string")
    ids = spark.createDataFrame([("a",), ("a",), (None,), ("none",)], "identifier string")
    assert {r.id for r in L.parallels(rel, ids).collect()} == {1, 2, 3, 5}
    var = spark.createDataFrame([(1, "c", "a", "z:1"), (2, "c", None, "a:1"), (3, "c", None, None), (4, "c", "b", "b:1")], "id long, corpus string, work_id string, segment_id string")
    assert {r.id for r in L.variants(var, ids).collect()} == {1, 2}
    assert L.variants(var, ids, 1).count() == 1


def test_resolve(spark):
    rel = [(1, "bridge:work", "ea1", "T1"), (2, "bridge:line_range", "ea1", "T1:0001a05..0001a09"), (3, "bridge:work", "ea2", "T1"), (4, "bridge:line_range", "ea3", "T1:0009a09..0001a01")]
    rel = spark.createDataFrame(rel, "id long, relation_type string, from_id string, to_id string")
    seg = {1: "T1:0001a05", 2: "T1:0001a09", 3: "T1:0001a10", 4: "T1:bad", 5: "T1:0001a01"}
    recs = spark.createDataFrame([rec(i, work_id="T1", segment_id=s) for i, s in seg.items()] + [rec(6, work_id="T1", segment_id="x", relation_ids='["T1:0001a01","T1:0001a06"]')], REC)
    ids = spark.createDataFrame([("ea1",), ("ea2",), ("ea3",), ("T1:0001a10",), ("none",)], "identifier string")
    got = {}
    for r in Z.resolve(ids, rel, recs).collect():
        got.setdefault(r.identifier, set()).add((r.id, r.locator))
    assert got["ea1"] == {(1, "segment_id"), (2, "segment_id"), (6, "relation_ids")}
    assert {i for i, _ in got["ea2"]} == {1, 2, 3, 4, 5, 6} and got["T1:0001a10"] == {(3, "segment_id")} and "ea3" not in got


# ---------------------------------------------------------------- search and pointers


def test_score_of_the_golden_case(spark):
    recs = spark.createDataFrame([rec(1, lemma_text="eva ahaṃ")], REC)
    lem = spark.createDataFrame([("evaṃ", "evaṃ", "w", "w:1")], "surface string, lemma string, work_id string, segment_id string")
    q = spark.createDataFrame([("q", "evaṃ")], "query_id string, query string")
    r = S.search(q, recs, lem, 5).first()
    assert r.score == 70 + 120 + 80 + 5 and r.match_reasons == ["exact", "corpus-lemma"]


def test_phrases_stay_within_a_column(spark):
    recs = spark.createDataFrame([rec(1, raw_text="a b c", norm_text="", folded_text="", compact_text=""), rec(2, raw_text="b a", norm_text="", folded_text="", compact_text="", title="b"), rec(3, raw_text="a", norm_text="b", folded_text="", compact_text="")], REC)
    lem = spark.createDataFrame([], "surface string, lemma string, work_id string, segment_id string")
    q = spark.createDataFrame([("q", "a b")], "query_id string, query string")
    assert {r.id for r in S.search(q, recs, lem, 5).collect()} == {1}


def test_cjk_inner_substring(spark):
    recs = spark.createDataFrame([rec(1, language="lzh", raw_text="如是我聞一時佛在" + "法" * 2000, norm_text="", folded_text="", compact_text=""), rec(2, language="lzh", raw_text="如是", norm_text="如是", folded_text="", compact_text="如是")], REC)
    lem = spark.createDataFrame([], "surface string, lemma string, work_id string, segment_id string")
    q = spark.createDataFrame([("q", "我聞一時")], "query_id string, query string")
    got = S.search(q, recs, lem, 5).collect()
    assert [r.id for r in got] == [1] and got[0].match_reasons == ["exact"]


def test_bm25_against_sqlite(spark):
    import sqlite3

    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(a, b, tokenize=\"unicode61 remove_diacritics 0\")")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    rnd = random.Random(1)
    words = ["evaṃ", "me", "sutaṃ", "ekaṃ", "如是", "X1"]
    rows = [(" ".join(rnd.choices(words, k=rnd.randrange(1, 9))), " ".join(rnd.choices(words, k=3))) for _ in range(60)]
    con.executemany("insert into t(a, b) values (?, ?)", rows)
    blank = dict(folded_text="", compact_text="", lemma_text="")
    recs = spark.createDataFrame([rec(i + 1, raw_text=a, norm_text=b, title=None, **blank) for i, (a, b) in enumerate(rows)], REC)
    for term in ("evaṃ", "x1", "me sutaṃ"):
        want = {i: -s for i, s in con.execute("select rowid, bm25(t) from t where t match ?", (f'"{term}"',))}
        terms = spark.createDataFrame([("q", term, term.split())], "query_id string, term string, tokens array<string>")
        got = {r.id: r.bm25 for r in S.bm25(S.phrase_hits(terms, S.postings(recs)), S.document_lengths(recs)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_best_sources_per_corpus(spark):
    rows = [(3, "alpha", "shared", "alpha/shared", 2, 195), (2, "alpha", "shared", "alpha/shared", 1, 195), (1, "alpha", "other", "alpha/other", 1, 150), (4, "beta", "b", "beta/w", 1, 130)]
    df = spark.createDataFrame(rows, "id long, corpus string, work_id string, source_path string, sequence_no long, score long").withColumn("query_id", F.lit("q"))
    assert [r.id for r in P.best_sources(df, 1).orderBy("rank").collect()] == [2, 4]
    assert [r.id for r in P.best_sources(df, 2).orderBy("rank").collect()] == [2, 1, 4]


def test_pointers_need_a_source(spark):
    rows = spark.createDataFrame([rec(1)], REC).withColumn("query_id", F.lit("q")).withColumn("query", F.lit("q")).withColumn("score", F.lit(1)).withColumn("match_reasons", F.array(F.lit("exact"))).withColumn("rank", F.lit(1))
    src = spark.createDataFrame([("c", "host/repo", "c")], "corpus string, repository string, repo_path string")
    p = P.pointers(rows, src).first().pointers
    assert p[0].source_path == "w.json" and p[0].indexed_source_path == "c/w.json"
    with pytest.raises(Exception, match="missing source mapping"):
        P.pointers(rows, src.filter("false")).collect()
    with pytest.raises(Exception, match="outside its repository"):
        P.pointers(rows.withColumn("source_path", F.lit("d/w.json")), src).collect()


def test_distribution_is_nearest_rank(spark):
    df = spark.range(1, 11).withColumnRenamed("id", "v")
    assert tuple(P.distribution(df, "v").first()) == (10, 5.5, 5, 10, 10)
    assert tuple(P.distribution(df.filter("false"), "v").first()) == (0, 0.0, 0, 0, 0)


def test_compact_round_trip_and_dangling(spark):
    rows = spark.createDataFrame([rec(i) for i in (1, 2)], REC).withColumn("record_id", F.col("id"))
    from codexmill.functions import ids as I

    static = [F.col(c) for c in P.STATIC]
    rows = rows.select(F.lit("q").alias("query_id"), F.lit(1).alias("rank"), F.lit(5).alias("score"), F.array(F.lit("exact")).alias("match_reasons"), *static, I.content_id(*static, names=list(P.STATIC)).alias("pointer_id"))
    refs, tab = P.compact(rows)
    assert T.setdiff(P.reconstruct(refs, tab), rows).count() == 0
    with pytest.raises(Exception, match="dangling"):
        P.reconstruct(refs, tab.limit(1)).collect()


# ---------------------------------------------------------------- tables and export


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "p"), (None, 2, "q")], "k string, n int, v string")
    assert sorted(r.v for r in T.insert_or_ignore(df, ["k"], ["n"]).collect()) == ["p", "q", "y"]
    assert sorted(r.v for r in T.upsert(df, ["k"], ["n"]).collect()) == ["q", "x"]


def test_blank_and_roles(spark):
    df = spark.createDataFrame([("  　\n", "unspecified", "c", None), ("x", "unspecified", "c", "root:ms"), ("y", "kept", "c", None)], "raw_text string, text_role string, corpus string, witness string")
    got = T.backfill_roles(T.drop_blank(df), {"c": "by_corpus"}, {"root:": "by_witness"}).collect()
    assert [r.text_role for r in got] == ["by_witness", "kept"]


def test_incremental_build(spark, tmp_path):
    out, runs = str(tmp_path / "t"), []

    def source(name):
        def parse():
            runs.append(name)
            return {"records": spark.createDataFrame([(1, f"text {len(runs)}")], "id long, raw_text string")}

        return parse

    src = {"a": ("s1", "v1", source("a")), "b": ("s1", "v1", source("b"))}
    assert T.build(spark, out, src) == ["a", "b"] and T.build(spark, out, src) == []
    src["b"] = ("s2", "v1", source("b"))
    assert T.build(spark, out, src) == ["b"] and runs == ["a", "b", "b"]
    assert {(r.corpus, r.raw_text) for r in spark.read.parquet(out + "/records").collect()} == {("a", "text 1"), ("b", "text 3")}
    with pytest.raises(ValueError):
        T.build(spark, out, src, only=["zzz"])


def test_shards_cover_all_rows_once(spark, tmp_path):
    recs = spark.createDataFrame([rec(i, corpus="cd"[i % 2], raw_text="x" * i) for i in range(1, 80)], REC)
    sh = E.shards(recs, 2000)
    rows = sh.collect()
    assert sorted(r.id for r in rows) == list(range(1, 80)) and max(r.shard for r in rows) > 2
    over = E.overlap(recs, sh).filter("role = 'context_overlap'").groupBy("corpus", "shard").count().collect()
    assert all(1 <= r["count"] <= 4 for r in over)
    E.write_shards(recs, sh, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 79
    loc = E.locator_rows(E.locator(recs, sh))
    E.write_locator(loc, str(tmp_path / "l"))
    assert E.read_locator(spark, str(tmp_path / "l"), "identifier", "w").count() == 1
    assert E.locate(spark, str(tmp_path / "l"), "identifier", "w").key == "w"
    with pytest.raises(LookupError):
        E.locate(spark, str(tmp_path / "l"), "identifier", "none")
    many = E.parts(loc, ["namespace", "bucket"], ["key"], 200)
    st = E.part_stats(many, ["namespace", "bucket"], "key").collect()
    assert sum(r["items"] for r in st) == loc.count() and all(r.first_key <= r.last_key for r in st)


def test_publishing_keeps_the_old_until_the_new_is_whole(spark, tmp_path):
    from codexmill.session import publish

    out = str(tmp_path / "out")
    publish(spark, out, lambda p: spark.range(3).write.parquet(f"{p}/t"))
    assert spark.read.parquet(f"{out}/t").count() == 3

    def fails(p):
        spark.range(9).write.parquet(f"{p}/t")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        publish(spark, out, fails)
    assert spark.read.parquet(f"{out}/t").count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]
    publish(spark, out, lambda p: spark.range(5).write.parquet(f"{p}/t"))
    assert spark.read.parquet(f"{out}/t").count() == 5
    other = tmp_path / "other"
    other.mkdir()
    (other / "mine.txt").write_text("x")
    with pytest.raises(ValueError, match="not published"):
        publish(spark, str(other), lambda p: spark.range(1).write.parquet(p))


def test_prefixes_as_like_compares_them(spark):
    v = spark.createDataFrame([(i, "c", None, x) for i, x in enumerate(["Ab:1", "ab:2", "aXb", "É1", "é1", None, "50%x", "a\\b"])], "id long, corpus string, work_id string, segment_id string")
    find = lambda x, **kw: {r.id for r in L.variants(v, spark.createDataFrame([(x,)], "identifier string"), **kw).collect()}
    assert find("AB", like=True) == {0, 1} and find("AB") == set() and find("a_b", like=True) == {2, 7} and find("a%b", like=True) == {0, 1, 2, 7}
    assert find("É", like=True) == {3} and find("a\\", like=True) == {7} and find("50%", like=True) == {6}


def test_supersession(spark):
    rows = [(1, None, 1), (2, 1, 2), (3, 1, 3), (4, 9, 4), (5, 6, 5), (6, 6, 6), (7, 2, 7), (None, 1, 8), (8, 7, None)]
    got = {r.id: (r.status, r.problem) for r in G.supersession(spark.createDataFrame(rows, "id long, supersedes long, at long")).collect()}
    assert got == {1: ("superseded", None), 2: ("superseded", None), 3: ("active", "branch"), 4: ("active", "missing"), 5: ("active", "not earlier"), 6: ("active", "not earlier"), 7: ("active", None), None: ("active", "unordered"), 8: ("active", "unordered")}
    assert G.supersession(spark.createDataFrame([], "id long, supersedes long, at long")).count() == 0


def test_citations_and_lists(spark):
    items = spark.createDataFrame([(1, ["a", "b", "a", None]), (2, ["z"]), (3, []), (4, None)], "id long, ids array<string>")
    got = {r.id: (r.n_cited, r.n_found, r.missing, r.complete) for r in G.citations(items, spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "id string")).collect()}
    assert got == {1: (2, 2, [], True), 2: (1, 0, ["z"], False), 3: (0, 0, [], True), 4: (0, 0, [], True)}
    ok = spark.createDataFrame([(["a", "b"],), (["a", "a"],), (["a", " "],), (["a", None],), (["a", "b", "c"],), (["long"],), (None,), ([],)], "x array<string>").select(G.valid_list(F.col("x"), 2, 3).alias("ok"))
    assert [r.ok for r in ok.collect()] == [True, False, False, False, False, False, False, True]
    js = spark.createDataFrame([('{"b": 1, "a": [true, 1.0]}',), ('{"a":[true,1.0],"b":1}',), ('{"a": [1, 1.0], "b": 1}',), ('{"a": 1, "a": 1}',), ("{",), (None,)], "x string").select(G.canonical_json("x").alias("c"))
    c = [r.c for r in js.collect()]
    assert c[0] == c[1] != c[2] and c[3] is c[4] is c[5] is None


def test_declared_sources(spark):
    r = spark.createDataFrame([("c", "w1", "p"), ("c", "w1", "p"), ("c", "w2", "p"), ("c", "w2", "q"), ("d", "w3", None)], "corpus string, work_id string, source_path string")
    d = spark.createDataFrame([("c", "w1"), ("c", "w1"), ("c", "w2"), ("c", "w9"), ("d", "w3")], "corpus string, work_id string")
    got = {r.work_id: (r.n_files, r.source_path, r.status) for r in G.declared_sources(d, r).collect()}
    assert got == {"w1": (1, "p", "found"), "w2": (2, None, "ambiguous"), "w9": (0, None, "missing"), "w3": (0, None, "missing")}


# ---------------------------------------------------------------- verification


def test_quotes():
    f = V.quote_status_of
    assert f("permanent", "impermanent") == "QUOTE_MISMATCH" and f("permanent", "impermanent permanent") == "VERIFIED_EXACT"
    assert f("是我", "如是我聞") == "VERIFIED_EXACT" and f("a  b", "a\nb") == "VERIFIED_NORMALIZED"
    assert f("A b", "a b") == "QUOTE_MISMATCH" and f(" ", "a") == "UNVERIFIED" and f(None, "a") == "UNVERIFIED"


def test_evidence_gate(spark):
    c = "evidence_id string, corpus string, repository string, source_sha string, source_path string, work_id string, segment_id string, sequence_no long, evidence_class string, text_role string, quotation string"
    good = ("e1", "c", "h/r", "a" * 40, "x/y.json", "w", "w:1", 1, "canonical_root", "root_text", "evaṃ")
    cand = spark.createDataFrame([good, ("e2", *good[1:10], "sutam"), ("e3", *good[1:3], "zz", *good[4:]), ("e4", *good[1:])], c)
    contract = spark.createDataFrame([("c", "p", "h/r", "a" * 40, "canonical_root")], "corpus string, repo_path string, repository string, source_sha string, evidence_class string")
    o = "evidence_id string, content string, excerpt_range array<int>, context_range array<int>, repository string, source_sha string, source_path string, blob_sha string, work_id string, segment_id string, sequence_no long"
    read = lambda *ids, **kw: spark.createDataFrame([(e, kw.get("content", "so evaṃ me"), [3, 7], kw.get("context", [0, 10]), "h/r", "a" * 40, "x/y.json", kw.get("blob"), "w", "w:1", 1) for e in ids], o)
    opened = read("e1", "e2", "e3")
    gate = lambda *a, **kw: {r.evidence_id: (r.gate, {k for k, v in r.checks.items() if v == "FAIL"}) for r in V.evidence_checks(*a, **kw).collect()}
    got = gate(cand, contract, opened, opened)
    assert {k: v[0] for k, v in got.items()} == {"e1": "VERIFIED", "e2": "REJECTED", "e3": "REJECTED", "e4": "UNVERIFIED"} and got["e2"][1] == {"quotation"}
    e = V.evidence_checks(cand, contract, opened, opened).filter("evidence_id = 'e1'").first().evidence
    assert (e.before, e.text, e.after) == ("so ", "evaṃ", " me")
    one = cand.filter("evidence_id = 'e1'")
    assert gate(one, contract, opened)["e1"] == ("UNVERIFIED", set()), "one reading is none"
    assert gate(one, contract, opened, read("e1", content="so evaṃ mE"))["e1"] == ("REJECTED", {"independent_content"})
    assert gate(one, contract, read("e1", context=[4, 10]), opened)["e1"] == ("REJECTED", {"context_contains_excerpt", "independent_context_range"})
    assert gate(one, contract.withColumn("blob_required", F.lit(True)), opened, opened)["e1"][0] == "UNVERIFIED"
    assert gate(one, contract, read("e1", blob="b" * 40), opened)["e1"] == ("REJECTED", {"opened_blob"})
    assert gate(one, contract, opened, opened, mode="research")["e1"] == ("REJECTED", {"run_id"}) and gate(one.withColumn("run_id", F.lit("r")), contract, opened, opened, mode="research")["e1"][0] == "VERIFIED"
    assert gate(one.withColumn("indexed_source_path", F.lit("q/x/y.json")), contract, opened, opened)["e1"] == ("REJECTED", {"indexed_source_path"})
    assert gate(cand.filter("false"), contract, opened, opened) == {}


def test_families_merge_by_derivation(spark):
    ev = spark.createDataFrame([("g", "a", "s1"), ("g", "b", "s1"), ("g", "c", "s2"), ("g", "d", "s3")], "grp string, id string, src string")
    r = V.independent_sources(ev, "grp", family=["src"]).first()
    assert (r.n_items, r.n_families) == (4, 3)
    d = spark.createDataFrame([("c", "a"), ("d", "c")], "id string, from_key string")
    assert V.independent_sources(ev, "grp", d, family=["src"]).first().n_families == 1


def test_long_chains_of_derivation_are_followed_to_their_end(spark):
    n = 150
    ev = spark.range(n).select(F.lit("g").alias("grp"), F.format_string("k%05d", "id").alias("id"), F.col("id").cast("string").alias("src"))
    d = spark.range(1, n).select(F.format_string("k%05d", "id").alias("id"), F.format_string("k%05d", F.col("id") - 1).alias("from_key"))
    assert V.independent_sources(ev, "grp", d, family=["src"]).first().n_families == 1


def test_strict_json(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ("{",), (None,)], "t string")
    assert [r.x for r in df.select(V.strict_json("t").alias("x")).collect()] == [True, False, False, None]


def test_spooled_tables_can_be_swept(spark):
    from codexmill import session

    df = session.spool(spark.range(5), "sweep")
    assert df.count() == 5 and df.inputFiles()
    assert session.sweep(spark) >= 1 and session.sweep(spark) == 0
    with pytest.raises(Exception, match="(?i)path|exist|file"):
        session.spool(spark.range(1), "x").sparkSession.read.parquet(df.inputFiles()[0]).count()


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from codexmill import session

    def of(master, folder=None):
        conf = {"spark.checkpoint.dir": folder} if folder else {}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(of(master))
        assert session.shared_dir(of(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_dir(of("local[4]")).startswith("file://")


def test_broadcasts_are_measured_in_bytes(spark):
    from codexmill import session

    df = spark.range(10).withColumn("x", F.array(*[F.lit("long text " * 10)] * 20))
    hint = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hint(session.broadcast_within(df, 100_000)) and not hint(session.broadcast_within(df, 10_000)), "few rows may be wide"
    assert session.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    many = spark.range(10, numPartitions=50)
    assert session.spread(many) is many


def test_phrase_scan_meets_phrases_whole(spark):
    """What the postings give, though every phrase of 600 begins with one word, which 300 records hold in four columns: word by word, 1.4 million meetings."""
    words = [f"w{i}" for i in range(600)]
    rnd = random.Random(2)
    recs = spark.createDataFrame([rec(i, raw_text="Om " + rnd.choice(words), norm_text=f"om {rnd.choice(words)} om w1 w2", folded_text="", compact_text=None, lemma_text="om w1, om w1", title="w1 w2" if i % 2 else None) for i in range(1, 301)], REC)
    terms = spark.createDataFrame([(w, f"om {w}", ["om", w]) for w in words] + [("one", "om", ["om"]), ("three", "om w1 w2", ["om", "w1", "w2"]), ("none", "w2 w1", ["w2", "w1"])], "query_id string, term string, tokens array<string>")
    got, want = ({tuple(r) for r in f.collect()} for f in (S.phrase_scan(terms, recs), S.phrase_hits(terms, S.postings(recs))))
    assert got == want and {q for q, *_ in got} >= {"one", "three", "w1"}
    assert S.phrase_scan(terms.limit(0), recs).collect() == []


def test_word_pairs_read_no_postings(spark, monkeypatch):
    """Joined with the postings a word at a time, the pairs of a whole corpus grow as its square."""
    from codexmill.plans import corpus

    def refuse(*_):
        raise AssertionError("postings meet every phrase that holds their word")

    monkeypatch.setattr(S, "phrase_hits", refuse)
    assert corpus.QUERIES["fts_word_pairs"](spark, "/root/testdata/sf0.001").count() > 0


def test_search_every_finds_and_scores_as_search(spark):
    """Words, phrases, other forms of a lemma, places and Chinese, in one part and in several."""
    texts = ["evaṃ me sutaṃ", "me evaṃ", "Sutena me", "sutaṃ evaṃ me sutaṃ", "nothing", "", "如是我聞一時佛", "evam me"]
    recs = spark.createDataFrame(
        [rec(i, corpus=f"c{i % 2}", language="lzh" if "如" in x else "pli", work_id=None if i == 4 else f"w{i % 3}", segment_id=None if i == 4 else f"s{i}", source_path=f"p{i % 3}", raw_text=x, norm_text=x.lower(), folded_text=x.lower().replace("ṃ", "m"), compact_text=x.lower().replace(" ", ""), lemma_text="suta ahaṃ" if i == 2 else "") for i, x in enumerate(texts)], REC
    )
    lem = spark.createDataFrame([("sutaṃ", "suta", "w0", "s0"), ("sutena", "suta", "w2", "s2"), ("evaṃ", "evaṃ", None, None), ("me", "ahaṃ", "w1", "s1")], "surface string, lemma string, work_id string, segment_id string")
    q = spark.createDataFrame([(x, x) for x in ("suta", "evaṃ", "ahaṃ", "me sutaṃ", "EVAṂ me", "如是我聞", "absent", "sutaṃ")], "query_id string, query string")
    cols = ["query_id", "query", *S.KEEP, "score", "match_reasons"]
    rows = lambda df: {str(tuple(r)) for r in df.select(*cols).collect()}
    want = S.search(q, recs, lem, 1 << 30, candidates="all")
    assert len({r.query_id for r in want.collect()}) == 7 and rows(S.search_every(q, recs, lem)) == rows(want)
    best = lambda df: {(r.query_id, r.id, r["rank"]) for r in P.best_sources(df.select(*cols), 1).collect()}
    assert best(S.search_every(q, recs, lem)) == best(want)
    most, S.BROADCAST_BYTES = S.BROADCAST_BYTES, 400
    try:
        assert rows(S.search_every(q, recs, lem)) == rows(want)
    finally:
        S.BROADCAST_BYTES = most


@pytest.mark.parametrize("name", ["pointer_rank", "query_stats"])
def test_pointers_of_all_lemmas_store_no_hits_and_no_index(spark, monkeypatch, name):
    """The postings of a whole corpus, or its texts once a hit, are more than the disk holds."""
    from codexmill.plans import corpus

    def refuse(*_, **__):
        raise AssertionError("an index of the whole corpus, or a row a hit, is written")

    for f in ("write_index", "postings", "phrase_hits", "scored"):
        monkeypatch.setattr(S, f, refuse)
    monkeypatch.setattr(corpus, "_INDEXED", {})
    assert corpus.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
