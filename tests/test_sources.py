"""Source formats: parsers on small files, scans and the tables they give."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from codexmill.sources import aligned as A
from codexmill.sources import config as C
from codexmill.sources import files as S
from codexmill.sources import formats as P


def recs(rows):
    return [(r["segment_id"], r["raw_text"]) for r in rows if r["kind"] == "record"]


def test_segment_json():
    body = json.dumps({"mn1:0": " ", "mn1:1": "a <b>x</b> &amp; c", "mn1:2": "d", "mn1:3": 5}).encode()
    rows = list(P.segment_json()("translation/en/mn/mn1_translation-en-x.json", body))
    assert recs(rows) == [("mn1:1", "a  x  & c"), ("mn1:2", "d")] and rows[0]["sequence_no"] == 1 and rows[0]["witness"] == "translation:translation-en-x"
    assert rows[0]["evidence_class"] == "authoritative_structured" and rows[0]["language"] == "en" and rows[0]["work_id"] == "mn1"
    one = list(P.segment_json(chunked=True)("root/pli/mn/mn1_root-pli-ms.json", json.dumps({f"mn1:{i}": f"t{i}" for i in range(120)}).encode()))
    assert [r["segment_id"] for r in one] == ["mn1:0..mn1:49", "mn1:50..mn1:99", "mn1:100..mn1:119"] and one[2]["sequence_no"] == 2 and one[0]["relation_ids"] == ["mn1:0", "mn1:49"]
    v = list(P.segment_json(chunked=True)("variant/pli/mn/mn1_variant-pli-ms.json", json.dumps({"mn1:1": "x", "mn1:2": "y"}).encode()))
    assert v[0]["reading"] == "mn1:1: x\nmn1:2: y" and v[0]["kind"] == "variant"
    assert list(P.segment_json()("root/pli/a.json", b"[1")) == [] and list(P.segment_json()("other/pli/a.json", b"{}")) == []


def test_relations():
    rows = list(P.parallels_json()("p.json", b'{"a": {"full": ["b", "c"]}}'))
    assert [(r["from_id"], r["to_id"]) for r in rows] == [("a", "b"), ("b", "a"), ("a", "c"), ("c", "a")] and rows[0]["relation_type"] == "parallel:full"
    works = list(P.extra_info_json("x.json", b'[{"uid": "mn1", "acronym": "MN 1"}, {"acronym": "none"}]'))
    assert [(w["work_id"], w["title"]) for w in works] == [("mn1", "MN 1")]
    page = '<article id="ea1"></article><a id="t0563a14"></a><a id="T563a7">x</a><a href="https://corpus.example/T2n125">y</a>'
    rows = list(P.bridge_html("corpus.example")("a.html", page.encode()))
    assert rows == []
    rows = list(P.bridge_html("corpus.example")("a.html", page.replace("T2n125", "T2n0125").encode()))
    assert [(r["relation_type"], r["to_id"]) for r in rows] == [("bridge:work", "T02n0125"), ("bridge:line_range", "T02n0125:0563a07..0563a14")]
    two = page.replace("T2n125", "T2n0125#T02n0126")
    assert [r["relation_type"] for r in P.bridge_html("corpus.example")("a.html", two.encode())] == ["bridge:work"] * 2


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="T01"><teiHeader><title level="m">Great  Title</title></teiHeader><text><body><p>pre<lb n="0001a01"/>如是<note>no<app from="#x"><lem wit="A">甲</lem>
<rdg wit="B" resp="R">乙</rdg><rdg wit="C"/></app>in</note>我<lb n="0001a02"/>聞<lb/>x</p></body></text></TEI>"""


def test_line_tei():
    rows = list(P.line_tei("T/T01/T01.xml", TEI.encode()))
    got = recs(rows)
    assert got[0] == ("T01:T01:head", "pre") and got[1][0] == "T01:0001a01" and got[1][1].startswith("如是") and got[1][1].endswith("我") and "no" not in got[1][1] and "in" in got[1][1]
    assert got[2:] == [("T01:0001a02", "聞"), ("T01:0001a02", "x")]
    v = [r for r in rows if r["kind"] == "variant"]
    assert [(r["reading"], r["witnesses"], r["lemma"], r["segment_id"]) for r in v] == [("乙", "B", "甲", "T01:x"), ("[omission]", "C", "甲", "T01:x")]
    assert [r["title"] for r in rows if r["kind"] == "work"] == ["Great Title"]


def test_passage_tei():
    x = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title type="mainTitle" xml:lang="en">Main</title></titleStmt><publicationStmt><idno xml:id="U1"/></publicationStmt>
    <sourceDesc><bibl key="toh1">b</bibl></sourceDesc></fileDesc></teiHeader><text><body><milestone xml:id="m1"/><head>Head</head><p xml:id="p1">one<note place="end">inner</note> two</p><lg><l>verse</l></lg><p><l>in</l></p></body></text></TEI>"""
    rows = list(P.passage_tei("kangyur/a.xml", x.encode()))
    r = [(q["segment_id"], q["raw_text"], q["text_role"], q["sequence_no"]) for q in rows if q["kind"] == "record"]
    assert r == [("m1", "Head", "translation_heading", 0), ("p1", "one two", "translation_main", 1), ("p1:synthetic-note:1:1", "inner", "translation_note", 1), ("m1", "verse", "translation_main", 2), ("m1", "in", "translation_main", 3)]
    assert [(q["from_id"], q["to_id"]) for q in rows if q["kind"] == "relation"] == [("p1:synthetic-note:1:1", "p1")]
    assert list(P.passage_tei("a.xml", b"<broken")) == []


def test_rdf():
    x = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:s="urn:s"><rdf:Description rdf:about="http://e/W1"><s:prefLabel xml:lang="bo">t</s:prefLabel><s:altLabel>u</s:altLabel>
    <s:sameAs rdf:resource="http://e/W2"/><s:other rdf:resource="http://e/W3"/></rdf:Description></rdf:RDF>"""
    rows = list(P.rdf_xml()("a.rdf", x.encode()))
    assert [(r["relation_type"], r["from_id"], r["to_id"]) for r in rows if r["kind"] == "relation"] == [("rdf:sameAs", "W1", "W2")]
    assert [(r["work_id"], r["title"], r["language"]) for r in rows if r["kind"] == "work"] == [("W1", "t", "bo")]


def test_line_text_runs():
    lines = ["T1n1_p0001a01####一", "T1n1_p0001a02####", "noise", "T1n2_p0001a03####", "T1n2_p0001a04####二[x]", "T1n2_p0001a05####<y>"]
    rows = list(P.line_text()("T/a.txt", "\n".join(lines).encode()))
    assert recs(rows) == [("T1n1:0001a01..0001a02", "一"), ("T1n2:0001a03..0001a05", "二")]
    assert len(list(P.line_text(chunked=False)("T/a.txt", "\n".join(lines).encode()))) == 5
    many = "\n".join(f"T1n1_p{i:04d}a01####字" for i in range(650))
    assert [r["raw_text"].count("字") for r in P.line_text()("T/a.txt", many.encode())] == [300, 300, 50]


def test_json_formats():
    z = gzip.compress(json.dumps({"T1_1:0": "如", "": "x"}).encode())
    assert [(r["work_id"], r["raw_text"]) for r in P.segmented_json("lzh")("d/T1.json.gz", z)] == [("T1_1", "如"), ("T1", "x")]
    lem = {"id": "mn1", "segments": [{"id": "mn1:1", "pali": "Evaṃ", "tokens": [{"word": "Evaṃ", "lemma": "evaṃ", "pos": "ind", "case": "n"}, {"word": "x"}]}]}
    rows = list(P.lemma_json()("a.json", json.dumps(lem).encode()))
    assert [r["kind"] for r in rows] == ["record", "lemma"] and rows[0]["lemma_text"] == "evaṃ " and json.loads(rows[1]["morphology_json"]) == {"case": "n"}
    crit = {"id": "mn1", "apparatus": [{"position": 3, "selected": "a", "type": "t", "confidence": 0.5}, {"selected": ""}]}
    assert [(r["segment_id"], r["confidence"]) for r in P.critical_json("a.json", json.dumps(crit).encode())] == [("mn1:token:3", 0.5)]


def test_translation_memory(spark):
    tm = {"text-id": "W", "tus": [{"tibetan": "བོད", "english": "x", "passage-xmlId": "p", "folio": None}, {"english": "y", "creation_method": "m"}]}
    files = [("d/a.json", json.dumps(tm).encode()), ("d/b.c.json", b'{"tus": [{"tibetan": "k"}]}'), ("d/bad.json", b"[1"), ("d/none.json", b"{}")]
    rows = A.translation_memory(spark.createDataFrame(files, "source_path string, content binary")).orderBy("source_path", "position").collect()
    assert [(r.segment_id, r.raw_text) for r in rows if r.kind == "record"] == [("W:tu:1:bo", "བོད"), ("W:tu:1:en", "x"), ("W:tu:2:bo", ""), ("W:tu:2:en", "y"), ("b.c:tu:1:bo", "k"), ("b.c:tu:1:en", "")]
    assert rows[0].relation_ids == ["W:tu:1", "p", ""] and rows[3].witness == "m" and rows[3].relation_ids == ["W:tu:2", "W:tu:2", ""]
    edges = [(r.from_id, r.to_id, json.loads(r.details_json)) for r in rows if r.kind == "relation"]
    assert edges[0] == ("W:tu:1:bo", "W:tu:1:en", {"passage_id": "p", "folio": None, "creation_method": None}) and len(edges) == 3


def test_configuration_is_strict(spark):
    got = C.sources_of(spark, '{"sources": {"a": {"repo_path": "r/a", "source_sha": "1"}, "b": {"repo_path": "r/b"}}}').collect()
    assert {(r.corpus, r.repo_path, r.source_sha) for r in got} == {("a", "r/a", "1"), ("b", "r/b", None)}
    for bad in ('{"sources": {"a": {}, "a": {}}}', '{"sources": {"a": {"x": "1"}}}', '{"sources": {"a": {"repo_path": "r"}, "b": {"repo_path": "r"}}}', "[]", "{"):
        with pytest.raises(ValueError):
            C.sources_of(spark, bad)


def test_paged_text():
    rows = list(P.paged_text("pli")("a.txt", b"Title\nbefore\npage 1\n====\nx\ny\npage 2\n\npage 3\nz"))
    assert recs(rows) == [("Title:page:1", "x\ny"), ("Title:page:3", "z")] and [r["sequence_no"] for r in rows] == [0, 1]


def test_scan_and_split(spark, tmp_path):
    d = tmp_path / "root/pli/mn"
    d.mkdir(parents=True)
    (d / "mn1_root-pli-ms.json").write_text(json.dumps({"mn1:1": "Evaṃ", "mn1:2": "me"}))
    (d / "mn2_root-pli-ms.json").write_text(json.dumps({"mn2:1": "sutaṃ"}))
    rows = S.scan(spark, str(tmp_path), "root/*/*/*.json", P.segment_json())
    t = S.split(rows, "demo", "a" * 40)
    got = {(r.source_path, r.segment_id, r.norm_text) for r in t["records"].collect()}
    assert got == {("root/pli/mn/mn1_root-pli-ms.json", "mn1:1", "evaṃ"), ("root/pli/mn/mn1_root-pli-ms.json", "mn1:2", "me"), ("root/pli/mn/mn2_root-pli-ms.json", "mn2:1", "sutaṃ")}
    assert t["works"].count() == t["relations"].count() == t["lemmas"].count() == 0


def test_aligned(spark, tmp_path):
    (tmp_path / "W1-bo.txt").write_text("ka\nkha\n")
    (tmp_path / "W1-en.txt").write_text("a\r\nb\r\nc")
    (tmp_path / "cat.csv").write_bytes("﻿file,title,source\nW1-bo.txt,T,S\n".encode())
    lines = A.aligned_lines(spark, str(tmp_path), "*.txt")
    r = A.aligned_records(lines, A.read_catalog(spark, str(tmp_path / "cat.csv")))
    assert {(x.segment_id, x.raw_text, x.title) for x in r.collect()} == {("W1:line:1:bo", "ka", "T"), ("W1:line:2:bo", "kha", "T"), ("W1:line:1:en", "a", None), ("W1:line:2:en", "b", None), ("W1:line:3:en", "c", None)}
    assert {(x.from_id, x.to_id) for x in A.alignments(r).collect()} == {("W1:line:1:bo", "W1:line:1:en"), ("W1:line:2:bo", "W1:line:2:en")}


def test_lexicon(spark):
    lem = spark.createDataFrame([("A", "a", None, "p1", "{}"), ("a", "a", None, "p2", "{1}"), ("a", "a", "n", "p3", "{}")], "surface string, lemma string, pos string, source_path string, morphology_json string")
    got = A.lexicon(lem).orderBy(F.col("pos").asc_nulls_first()).collect()
    assert [(r.surface, r.pos, r.source_path) for r in got] == [("a", None, "p1"), ("a", "n", "p3")]
