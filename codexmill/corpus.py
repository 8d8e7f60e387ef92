"""A corpus on disk and the single queries over it, for interactive use.

The tables live as Parquet below one folder, partitioned by corpus. Each method is
the batch operator with one row, and returns plain dicts; an empty answer says so.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import ids as I
from codexmill.operators import export as E
from codexmill.operators import lookup as L
from codexmill.operators import pointers as P
from codexmill.operators import resolve as R
from codexmill.operators import search as S
from codexmill.operators import tables as T
from codexmill.session import exists, publish, spool

TABLES = ("records", "works", "relations", "variants", "lemmas")
NOTHING = "not enough data in the present corpus"


def write_snapshot(tables: dict[str, DataFrame], out: str) -> None:
    """Writes tables sorted for lookups: by corpus, with Bloom filters on the ids that are looked up."""
    layout = {"records": (["work_id", "source_path", "sequence_no"], ["work_id", "segment_id"]), "relations": (["from_id"], ["from_id", "to_id"]), "variants": (["segment_id"], ["work_id", "segment_id"]), "lemmas": (["surface"], ["surface", "lemma"]), "works": (["work_id"], ["work_id"])}
    for name, df in tables.items():
        order, bloom = layout.get(name, ([], []))
        w = (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite")
        for c in bloom:
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        (w.partitionBy("corpus") if "corpus" in df.columns else w).parquet(f"{out}/{name}")


class Corpus:
    def __init__(self, spark: SparkSession, path: str, suffix: str = "", index: str | None = None):
        """``index``: folder of a stored index (``search.write_index``); without, searches build theirs."""
        self.spark, self.path = spark, path.rstrip("/")
        self.index = S.read_index(spark, index) if index else {}
        for name in TABLES:
            setattr(self, name, spark.read.parquet(f"{self.path}/{name}{suffix}"))

    def _one(self, value, name: str = "identifier", kind: str = "string") -> DataFrame:
        return self.spark.createDataFrame([(value,)], f"{name} {kind}")

    @staticmethod
    def _rows(df: DataFrame) -> list[dict]:
        return [json.loads(x) for x in df.toJSON().collect()]  # every caller's frame is limited

    def _answer(self, key: str, value, name: str, df: DataFrame) -> dict:
        rows = self._rows(df)
        return {key: value, name: rows, "found": bool(rows), "message": None if rows else NOTHING}

    def status(self) -> dict:
        return {"path": self.path, "counts": {r["table_name"]: r["rows"] for r in self._rows(L.status({n: getattr(self, n) for n in TABLES}))}}

    def search(self, query: str, limit: int = 20, language: str | None = None, corpus: str | None = None, context: int = 0) -> dict:
        if context < 0:
            raise ValueError("context window must be non-negative")
        q = self.spark.createDataFrame([("q", query, language, corpus)], "query_id string, query string, language string, corpus string")
        q = q.drop(*[c for c, v in (("language", language), ("corpus", corpus)) if v is None])
        hits = S.search(q, self.records, self.lemmas, limit, **self.index).orderBy("rank").drop("query_id")
        out = self._answer("query", query, "results", hits)
        if context and out["results"]:
            ids = self.spark.createDataFrame([(r["id"],) for r in out["results"]], "id long")
            near: dict = {}
            for r in L.context(self.records, context, ids).orderBy("id", "offset").collect():  # at most 2 * context rows a hit
                near.setdefault(r.id, {"before": [], "after": []})["before" if r.offset < 0 else "after"].append(r.neighbour)
            for r in out["results"]:
                r["context"] = near.get(r["id"], {"before": [], "after": []})
        return out | {"fail_closed": not out["found"]}

    def context(self, record_id: int, window: int = 2) -> dict:
        near = L.context(self.records, window, self._one(record_id, "id", "long")).select(F.col("neighbour").alias("id"), "offset")
        here = self.spark.createDataFrame([(record_id, 0)], "id long, offset long")
        return self._answer("record_id", record_id, "context", self.records.join(F.broadcast(near.unionByName(here)), "id").orderBy("offset"))

    def provenance(self, record_id: int) -> dict:
        return self._answer("record_id", record_id, "provenance", L.provenance(self.records, self._one(record_id, "id", "long")))

    def evidence(self, record_id: int, window: int = 2) -> dict:
        out = self.context(record_id, window)
        me = next((r for r in out["context"] if r["id"] == record_id), None)
        if me is None:
            return {"record_id": record_id, "found": False, "message": NOTHING}
        ids = self.spark.createDataFrame([(v,) for v in {me.get("work_id"), me.get("segment_id")} - {None}], "identifier string")
        v = L.variants(self.variants, ids).drop("identifier", "rank").dropDuplicates(["id"]).orderBy("corpus", "segment_id", "id").limit(500)
        return out | {"record": me, "provenance": {k: me.get(k) for k in L.PROVENANCE}, "variants": self._rows(v)}

    def work(self, identifier: str) -> dict:
        w = self.works.filter(F.col("work_id") == identifier).orderBy("corpus").limit(100)
        r = L.work(self.works, self._one(identifier), 100, self.records).orderBy("rank")
        works, rows = self._rows(w), self._rows(r)
        return {"identifier": identifier, "works": works, "records": rows, "found": bool(works or rows), "message": None if works or rows else NOTHING}

    def parallels(self, identifier: str) -> dict:
        return self._answer("identifier", identifier, "relations", L.parallels(self.relations, self._one(identifier)).orderBy("rank"))

    def resolve(self, identifier: str, limit: int = 100) -> dict:
        hit = R.resolve(self._one(identifier), self.relations, self.records, limit).drop("identifier")
        return self._answer("identifier", identifier, "records", hit.join(self.records, "id").orderBy("rank"))

    def variants_of(self, identifier: str) -> dict:
        return self._answer("identifier", identifier, "variants", L.variants(self.variants, self._one(identifier)).orderBy("rank"))

    def compare(self, identifiers: list[str]) -> dict:
        ids = self.spark.createDataFrame([(i,) for i in identifiers], "identifier string")
        rows = self._rows(L.compare(self.records, ids).orderBy("identifier", "rank"))
        groups = [{"identifier": i, "records": [r for r in rows if r["identifier"] == i]} for i in identifiers]
        return {"groups": groups, "harmonized": False, "found": bool(rows), "message": None if rows else NOTHING}

    def export(self, out: str, target: int = E.SHARD_BYTES) -> None:
        """All records in shards, relations and variants in parts, the locator of the records' keys, and what each part holds.

        Everything is written beside ``out`` and put in its place when it is whole.
        """

        def write(stage: str) -> None:
            sh = spool(E.shards(self.records, target), "shards")
            E.write_shards(self.records, sh, f"{stage}/records")
            manifest = E.shard_stats(sh).select("corpus", F.lit("records").alias("kind"), F.col("shard").alias("part"), "items", "bytes")
            for kind in ("relations", "variants"):
                p = spool(E.parts(getattr(self, kind), ["corpus"], ["id"], target), kind)
                E.write_parts(p, ["corpus"], "id", f"{stage}/{kind}")
                manifest = manifest.unionByName(E.part_stats(p, ["corpus"], "id").select("corpus", F.lit(kind).alias("kind"), "part", "items", "bytes"))
            loc = E.locator_rows(E.locator(self.records, sh, self.lemmas))
            E.write_locator(loc, f"{stage}/locator").write.parquet(f"{stage}/locator_parts")
            manifest.write.parquet(f"{stage}/parts")

        publish(self.spark, out, write)

    def export_pointers(self, queries: list[str], identifiers: list[str], out: str, per_corpus: int = 5) -> dict:
        """Pointers of some terms and identifiers, in files by bucket of the key, with a manifest; returns the manifest's totals."""
        if per_corpus < 1:
            raise ValueError("at least one pointer a corpus")
        asked = [(f"term\x00{x}", x, "term") for x in dict.fromkeys(queries)] + [(f"identifier\x00{x}", x, "identifier") for x in dict.fromkeys(identifiers)]
        q = self.spark.createDataFrame(asked, "query_id string, query string, query_kind string")
        term = S.search(q.filter("query_kind = 'term'").select("query_id", "query"), self.records, self.lemmas, 1 << 30, candidates="all", **self.index).drop("rank")
        best = P.best_sources(term.unionByName(P.identifier_rows(self.records, q.filter("query_kind = 'identifier'")).select(*term.columns)), per_corpus)
        rows = best.join(q.select("query_id", "query_kind"), "query_id").groupBy("query_kind", F.col("query").alias("key"))
        p = F.struct("rank", F.col("score"), "match_reasons", F.col("id").alias("record_id"), *[c for c in P.STATIC if c != "record_id"])
        keyed = rows.agg(F.sort_array(F.collect_list(p)).alias("pointers")).withColumn("bucket", I.bucket(F.col("key")))  # a few a corpus
        parted = spool(E.parts(keyed.select("query_kind", "bucket", "key", "pointers"), ["query_kind", "bucket"], ["key"], E.LOCATOR_BYTES), "pointers")

        def write(stage: str) -> None:
            E.write_parts(parted, ["query_kind", "bucket"], "key", f"{stage}/pointers")
            E.part_stats(parted, ["query_kind", "bucket"], "key").write.parquet(f"{stage}/parts")

        publish(self.spark, out, write)
        n = parted.agg(F.count("*").alias("keys"), F.coalesce(F.sum(F.size("pointers")), F.lit(0)).alias("pointers"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first().asDict()
        return n | {"asked": len(asked), "without_result": len(asked) - n["keys"]}

    def materialize(self, out: str, per_corpus: int = 20) -> int:
        """Pointers of every key of the universe that ``out`` lacks; returns how many keys were new.

        A run is one batch: first its ``pointers``, then its ``keys`` with the number of pointers of each (0 for a
        key without hits, which is not searched again). Both are written over, so a batch that was lost half-way is
        written whole by the next run.
        """
        keys, batch = P.key_universe(self.lemmas, self.records), 0
        if exists(self.spark, f"{out}/keys"):
            done = self.spark.read.parquet(f"{out}/keys")
            keys, batch = P.pending(keys, done, ["query_kind", "key"]), done.agg(F.max("batch")).first()[0] + 1
        keys = spool(keys, "keys")
        n = keys.count()
        if not n:
            return 0
        q = keys.select(F.concat_ws("\x00", "query_kind", "key").alias("query_id"), F.col("key").alias("query"), "query_kind")
        term = S.search(q.filter("query_kind = 'term'").select("query_id", "query"), self.records, self.lemmas, 1 << 30, candidates="all").drop("rank")
        ident = P.identifier_rows(self.records, q.filter("query_kind = 'identifier'"))
        best = P.best_sources(term.unionByName(ident.select(*term.columns)), per_corpus)
        rows = best.join(q.select("query_id", "query_kind"), "query_id").withColumnRenamed("query", "key")
        rows.write.mode("overwrite").parquet(f"{out}/pointers/batch={batch}")
        found = self.spark.read.parquet(f"{out}/pointers/batch={batch}").groupBy("query_kind", "key").agg(F.count("*").alias("n_pointers"))
        keys.join(found, ["query_kind", "key"], "left").fillna(0, ["n_pointers"]).write.mode("overwrite").parquet(f"{out}/keys/batch={batch}")
        return n

    def purge(self, corpus: str) -> dict[str, DataFrame]:
        return {n: T.purge(getattr(self, n), corpus) for n in TABLES}
