"""The corpus on disk, its single queries, source spans and pinned blobs."""

import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from codexmill import __main__ as cli
from codexmill.corpus import TABLES, Corpus, write_snapshot
from codexmill.operators import search as S
from codexmill.sources import blobs, spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("snap"))
    write_snapshot({n: spark.read.parquet(f"{SF}/{n}.parquet") for n in TABLES}, out)
    return Corpus(spark, out)


def test_single_queries(corpus):
    r = corpus.records.filter("work_id <> '' and sequence_no > 2 and lemma_text <> ''").first()
    word = r.lemma_text.split()[0]
    assert corpus.status()["counts"]["records"] == 250
    hits = corpus.search(word, 5, context=1)
    assert hits["found"] and len(hits["results"]) <= 5 and hits["results"][0]["rank"] == 1 and "context" in hits["results"][0]
    assert corpus.search("no such word anywhere")["fail_closed"]
    assert all(x["corpus"] == r.corpus for x in corpus.search(word, 50, corpus=r.corpus)["results"])
    ctx = corpus.context(r.id, 1)
    assert r.id in [x["id"] for x in ctx["context"]] and len(ctx["context"]) <= 3
    ev = corpus.evidence(r.id)
    assert ev["record"]["id"] == r.id and ev["provenance"]["work_id"] == r.work_id and not corpus.evidence(-1)["found"]
    assert corpus.provenance(r.id)["found"] and corpus.work(r.work_id)["found"] and not corpus.work("nothing")["found"]
    assert len(corpus.compare([r.work_id, "nothing"])["groups"]) == 2
    e = corpus.relations.first()
    assert corpus.parallels(e.from_id)["found"]
    assert corpus.variants_of(corpus.variants.filter("work_id is not null").first().work_id)["found"]
    b = corpus.relations.filter("relation_type = 'bridge:work' and not contains(to_id, ':')").first()
    assert corpus.resolve(b.from_id)["identifier"] == b.from_id
    with pytest.raises(ValueError):
        corpus.search("x", context=-1)


def test_stored_index(corpus, spark, tmp_path):
    S.write_index(corpus.records, str(tmp_path / "i"))
    stored = Corpus(spark, corpus.path, index=str(tmp_path / "i"))
    words = [r.lemma_text.split()[0] for r in corpus.records.filter("lemma_text <> ''").limit(2).collect()]
    zh = corpus.records.filter("language = 'lzh' and length(compact_text) > 12").first().compact_text[4:8]
    for w in [*words, zh]:
        a, b = corpus.search(w, 10), stored.search(w, 10)
        assert a["results"] and [(x["id"], x["score"]) for x in a["results"]] == [(x["id"], x["score"]) for x in b["results"]]


def test_export_and_resumed_pointers(corpus, spark, tmp_path):
    corpus.export(str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e/records")).count() == 250
    out = str(tmp_path / "p")
    n = corpus.materialize(out, 3)
    ptr = spark.read.parquet(f"{out}/pointers")
    keys, n_ptr = spark.read.parquet(f"{out}/keys"), ptr.count()
    assert n > 0 and keys.count() == n and ptr.groupBy("query_kind", "key", "corpus").count().filter("count > 3").count() == 0
    assert keys.filter("n_pointers > 0").count() == ptr.select("query_kind", "key").distinct().count()
    assert corpus.materialize(out, 3) == 0 and spark.read.parquet(f"{out}/keys").count() == n
    shutil.rmtree(f"{out}/keys")  # as if the run had been lost before its keys
    assert corpus.materialize(out, 3) == n and spark.read.parquet(f"{out}/pointers").count() == n_ptr


def test_export_of_pointers(corpus, spark, tmp_path):
    lemma, work = corpus.lemmas.first().lemma, corpus.works.first().work_id
    m = corpus.export_pointers([lemma, "no such word at all"], [work, work], str(tmp_path / "p"), 3)
    assert m["asked"] == 3 and m["without_result"] >= 1 and m["pointers"] > 0
    rows = spark.read.text(str(tmp_path / "p/pointers")).collect()
    assert len(rows) == m["keys"] and spark.read.parquet(str(tmp_path / "p/parts")).agg(F.sum("items")).first()[0] == m["keys"]
    with pytest.raises(ValueError):
        corpus.export_pointers([], [], str(tmp_path / "p"), 0)


def test_command_line(corpus, capsys):
    assert cli.main(["--path", SF, "--suffix", ".parquet", "status"]) == 0
    assert json.loads(capsys.readouterr().out)["counts"]["records"] == 250
    assert cli.main(["--path", SF, "--suffix", ".parquet", "context", "--record-id", "1", "--window", "-1"]) == 2


def test_scan_search(corpus, spark):
    r = corpus.records.filter("language = 'en'").first()
    q = spark.createDataFrame([("q", r.raw_text[5:25])], "query_id string, query string")
    got = S.scan_search(q, corpus.records, 500).collect()
    assert r.id in {x.id for x in got} and got[0].kind == "exact"


def find(spark, kind, content, *selectors, path="a.json"):
    """Of each selector (segment, number, work, quotation) the excerpt, its ranges and the error."""
    rows = [(str(i), path, *(list(x) + [None] * 4)[:4]) for i, x in enumerate(selectors)]
    sel = spark.createDataFrame(rows, "evidence_id string, source_path string, segment_id string, sequence_no long, work_id string, quotation string")
    files = spark.createDataFrame([(path, content)], "source_path string, content string")
    got = {r.evidence_id: r for r in spans.resolve_spans(sel, files, kind).collect()}
    assert len(got) == len(rows)
    return [got[str(i)] for i in range(len(rows))]


def test_json_spans(spark):
    body = '{"mn1:1": "Evaṃ me", "mn1:2": "a\\u0062", "mn1:3": " ", "mn1:4": "x <b>y</b>", "mn1:5": "last"}'
    r, *bad, chunk, other = find(spark, "json", body, ("mn1:1", 0, "mn1"), ("mn1:2",), ("mn1:3",), ("mn1:4",), ("none",), ("mn1:1", 7), ("mn1:1..mn1:5", None, None, "last"), ("mn1:1", 0, "mn2"))
    assert r.excerpt == "Evaṃ me" == body[slice(*r.excerpt_range)] and body[slice(*r.context_range)].endswith('"a\\u0062"') and r.error is None
    assert all(x.error and x.excerpt is None and x.excerpt_range is None for x in (*bad, other))
    assert chunk.excerpt == "last"
    for wrong in ('{"a": "x", "a": "y"}', "[1]", '{"a": {"b": "c"}}', ""):
        with pytest.raises(ValueError):
            spans.json_units(wrong, "a.json")
        assert find(spark, "json", wrong, ("a",))[0].error
    assert [x.segment for x in spans.json_units(body, "a.json", True)] == ["mn1:1..mn1:5"]


def test_tei_spans(spark):
    line = '<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="T1"><text><body><p><lb n="1a01"/>如是<note>注</note>我聞<lb n="1a02"/>一時&amp;佛</p></body></text></TEI>'
    quoted, plain = find(spark, "line_tei", line, ("T1:1a01", 0, "T1", "我聞"), ("T1:1a01", 0, "T1"), path="T/T1.xml")
    assert quoted.excerpt == "我聞" == line[slice(*quoted.excerpt_range)] and plain.excerpt == "如是"
    assert [x.segment for x in spans.line_units(line, "T/T1.xml")] == ["T1:1a01", "T1:1a02"]
    page = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><publicationStmt><idno xml:id="U1"/></publicationStmt></fileDesc></teiHeader><text><body><head>H</head><p xml:id="p1">one<note>in</note> two</p></body></text></TEI>'
    u = spans.passage_units(page, "a.xml")
    assert [(x.segment, x.number) for x in u] == [("U1", 0), ("p1", 1), ("p1:synthetic-note:1:1", 1)]
    note, p1, one, none = find(spark, "passage_tei", page, ("p1:synthetic-note:1:1",), ("p1",), ("p1", 1, "U1", "one"), ("zz",), path="a.xml")
    assert note.excerpt == "in" and p1.excerpt == " two" and one.excerpt == "one" and none.error == "no such location"
    sel = spark.createDataFrame([("e1", "a.xml", "U1", "p1", 1, "one")] * 2 + [("e3", "b.xml", "U1", "p1", 1, None)], "evidence_id string, source_path string, work_id string, segment_id string, sequence_no long, quotation string")
    got = spans.resolve_spans(sel, spark.createDataFrame([("a.xml", page)], "source_path string, content string"), "passage_tei").collect()
    assert sorted((x.evidence_id, x.excerpt, x.error) for x in got if x.error is None) == [("e1", "one", None)] * 2 and [x.error for x in got if x.evidence_id == "e3"] == ["source is unavailable"]
    with pytest.raises(ValueError):
        spans.line_units('<!DOCTYPE x [<!ENTITY e "v">]><TEI><body/></TEI>', "x.xml")


def test_pinned_blobs(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=repo, capture_output=True, text=True, check=True).stdout.strip()
    run("init", "-q")
    (repo / "a.txt").write_text("如是\n")
    run("add", ".")
    run("commit", "-qm", "x")
    sha = run("rev-parse", "HEAD")
    df = spark.createDataFrame([("r", sha, "a.txt"), ("r", sha, "none"), ("missing", sha, "a.txt")], "repo_path string, source_sha string, path string")
    got = {(x.repo_path, x.path): (x.blob_sha, x.content) for x in blobs.pinned_blobs(df, str(tmp_path), True).collect()}
    assert got["r", "a.txt"] == (run("rev-parse", "HEAD:a.txt"), "如是\n") and got["r", "none"] == (None, None) and got["missing", "a.txt"] == (None, None)
