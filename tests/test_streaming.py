"""Streaming ingest over files."""

import json

from codexmill.streaming import ingest as G

SCHEMA = "corpus string, source_path string, segment_id string, language string, witness string, raw_text string, sequence_no long, at timestamp"


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))


def row(seg, text, n=1, **k):
    return {"corpus": "c", "source_path": "p", "segment_id": seg, "language": "pli", "witness": "w", "raw_text": text, "sequence_no": n, "at": "2024-01-01T00:00:00Z", **k}


def test_ingest_is_first_wins_across_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        G.ingest_records(G.read_rows(spark, str(src), SCHEMA), out, ck, ["sequence_no"]).awaitTermination(120)
        return sorted((r.segment_id, r.raw_text) for r in spark.read.parquet(out).collect())

    write(src / "a.json", [row("1", "one"), row("1", "late", 2), row("2", " ")])
    assert run() == [("1", "one")]
    write(src / "b.json", [row("1", "again"), row("3", "Três"), row("4", "x", witness=None), row("4", "x", witness=None)])
    assert run() == [("1", "one"), ("3", "Três"), ("4", "x"), ("4", "x")]
    assert {r.folded_text for r in spark.read.parquet(out).filter("segment_id = '3'").collect()} == {"tres"}


def test_arrivals(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src / "a.json", [row("1", "x"), row("2", "y"), row("3", "z", at="2024-01-03T00:00:00Z")])
    q = G.arrivals(G.read_rows(spark, str(src), SCHEMA), "at").writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("arrivals").collect()) == [1, 2]
