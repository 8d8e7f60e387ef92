"""Identifiers, lines, digests and paths."""

import hashlib
import subprocess

from pyspark.sql import functions as F

from codexmill.functions import ids as I


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first().x


def test_work_ids(spark):
    for a, b in [("T02N0125", "T02n0125"), ("T2n0125", "T02n0125"), (" t2n0125A ", "T02n0125a"), ("mn1", None), ("T1234n0125", None)]:
        assert one(spark, I.normalize_work_id(F.col("v")), v=a) == b


def test_lines(spark):
    assert one(spark, I.normalize_line(F.col("v")), v="t563a7") == "0563a07"
    assert one(spark, I.line_key(F.col("a")) < I.line_key(F.col("b")), a="0563a14", b="0563b01")
    assert one(spark, I.normalize_line(F.col("v")), v="x1") is None


def test_identifiers(spark):
    p = I.parse_identifier(F.col("v"))
    assert tuple(one(spark, p, v="plm1:0333a25..0336c12")) == ("plm1", "0333a25", "0336c12")
    assert tuple(one(spark, p, v="plm1:333a25")) == ("plm1", "0333a25", "0333a25")
    assert tuple(one(spark, p, v="plm1")) == ("plm1", None, None)
    assert one(spark, p, v="plm1:0336c12..0333a25") is None
    assert one(spark, I.parse_identifier(F.col("v"), I.normalize_work_id), v="mn1") is None


def test_interval_precedence(spark):
    f = I.record_interval(F.col("w"), F.col("s"), F.col("r"))
    df = spark.createDataFrame(
        [("a1", "a1:0001a01", ["a1:0002a01", "a1:0002b05"]), ("a1", "a1:0001a01", ["x"]), ("a1", "a1:0001a01", ["b1:0002a01", "b1:0002a02"]), ("a1", "odd", []), ("a1", "a1:0003a02", ["a1:0005a01", "a1:0004a01"])],
        "w string, s string, r array<string>",
    )
    got = [None if x.x is None else (int(x.x.lo[:4]), int(x.x.hi[:4]), x.x.locator) for x in df.select(f.alias("x")).collect()]
    assert got == [(2, 2, "relation_ids"), (1, 1, "segment_id"), (1, 1, "segment_id"), None, (3, 3, "segment_id")]


def test_digests(spark, tmp_path):
    assert one(spark, I.bucket(F.col("v")), v="käse") == hashlib.sha256("käse".encode()).hexdigest()[:2]
    body = "如是我聞\n"
    want = hashlib.sha1(b"blob " + str(len(body.encode())).encode() + b"\0" + body.encode()).hexdigest()
    assert one(spark, I.git_blob_sha(F.col("v")), v=body) == want
    (tmp_path / "f").write_text(body)
    assert subprocess.run(["git", "hash-object", "f"], cwd=tmp_path, capture_output=True, text=True).stdout.strip() == want


def test_paths_and_slugs(spark):
    ok = lambda v: one(spark, I.valid_path(F.col("v")), v=v)
    assert [ok(v) for v in ("a/b.json", "a", "/a", "a//b", "a/../b", "./a", "a:b", "a\\b", "a/")] == [True, True] + [False] * 7
    assert one(spark, I.slug(F.col("v")), v=" a b/c ") == "a-b-c" and one(spark, I.slug(F.col("v")), v="//") == "unknown"
    assert one(spark, I.work_from_segment(F.col("v")), v="mn1:1.1#x") == "mn1" and one(spark, I.work_from_segment(F.col("v")), v="") is None
    assert one(spark, I.relative_path(F.col("v"), "src"), v="src/a/b") == "a/b" and one(spark, I.relative_path(F.col("v"), "src"), v="srcx/a") is None


def test_aware_timestamps(spark):
    assert one(spark, I.aware_timestamp(F.col("v")), v="2024-01-01T00:00:00Z") is not None
    assert one(spark, I.aware_timestamp(F.col("v")), v="2024-01-01T00:00:00") is None


def test_content_id_keeps_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string")
    ids = [r.i for r in df.select(I.content_id(F.col("x"), F.col("y"), names=["x", "y"]).alias("i")).collect()]
    assert ids[0] == hashlib.sha256(b'{"x":"a","y":null}').hexdigest() and ids[0] != ids[1]
