"""Evaluation passages inside training documents.

Both texts are reduced to letters and numbers (compatibility-decomposed,
case-folded). A document holds a passage of an item if both share ``LENGTH`` or
more consecutive characters of their reduced texts.

Method: prefix-filtered set join. The shingles of every item-sized window (LENGTH
characters of an item) are a set that a document holding the window must contain
whole, so by the prefix principle one shingle of it, the rarest, suffices as the
join token.
1. *Shingles.* Items yield all their shingles. Documents yield those that pass a bit
   table of the items' shingles; the table has a fixed size, so it lets more foreign
   shingles through where there are more items, but never holds one of theirs back.
2. *Rarity.* A shingle's count over all documents, combined in each task before the
   shuffle. A window with a shingle that no document holds is nowhere; of any other the
   rarest shingle is its token. Equal windows of an item count once.
3. *Join.* Tokens meet the documents' shingles; documents are salted, so that a common
   token is not one task's. A match fixes the offset between both texts (the
   positional bound), and a window can only be there if enough characters remain on
   both sides (the length bound).
4. *Verifying.* The reduced texts are compared character by character along each offset.

The documents are read twice, for 1 and 4, however many items there are, and nothing
of items or documents goes through the driver but the bit table. Items with the same reduced
text are one until the result.

Defined results: null and empty texts, and such with fewer than LENGTH letters and
numbers, hold nothing; repeated items and documents each count for themselves;
rows without an id are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.llm.spans import phrase_hashes
from codexmill.session import spool

LENGTH, SHINGLE = 60, 20
#: Bits of the table, as a power of two: 8 MB.
BITS = 26
#: Tasks over which the documents with one token are spread.
SALT = 8
#: Characters of documents reduced at once.
CHUNK = 1_000_000

_KEEP: np.ndarray | None = None


def _keep() -> np.ndarray:
    """For every code point, whether it is a letter or number."""
    global _KEEP
    if _KEEP is None:
        import sys
        import unicodedata as u

        _KEEP = np.zeros(sys.maxunicode + 1, bool)
        for cp in range(sys.maxunicode + 1):
            if u.category(chr(cp))[0] in "LN":
                _KEEP[cp] = True
    return _KEEP


def reduced(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all reduced texts in a row, and where each begins (one more at the end)."""
    import unicodedata as u

    parts = [u.normalize("NFKD", t).casefold() if t else "" for t in texts]
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    a = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _keep()[a]
    before = np.concatenate([[0], np.cumsum(ok)])
    return a[ok], before[np.concatenate([[0], np.cumsum(lens)])]


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list]]:
    ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= CHUNK or i + 1 == len(texts):
            yield ids[first : i + 1], texts[first : i + 1]
            first, n = i + 1, 0


def _place(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and mask of the bit of each hash."""
    at = h >> np.uint64(64 - bits)
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def reduced_items(items: DataFrame) -> DataFrame:
    """(item_id, chars): each item's reduced text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _pieces(b):
                chars, at = reduced(texts)
                out = [chars[x:y].tobytes().decode("utf-32-le", "surrogatepass") for x, y in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["item_id", "chars"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, chars string")


def bit_table(classes: DataFrame, k: int, bits: int) -> np.ndarray:
    """Bits of the shingles of the items; at most 2 ** (bits - 6) words reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << max(0, bits - 6), np.uint64)
        for b in batches:
            for t in b.column(0).to_pylist():
                word, mask = _place(phrase_hashes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), k), bits)
                np.bitwise_or.at(table, word, mask)
        word = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(table[word].view(np.int64))], names=["word", "mask"])

    table = np.zeros(1 << max(0, bits - 6), np.uint64)
    got = classes.select("chars").mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table[got["word"].to_numpy()] = got["mask"].to_numpy(np.int64).view(np.uint64)
    return table


def document_shingles(docs: DataFrame, table, k: int, bits: int) -> DataFrame:
    """(h, doc_id, at, left): the documents' shingles that pass the table, where they stand, and how many characters follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            for ids, texts in _pieces(b):
                chars, at = reduced(texts)
                h = phrase_hashes(chars, k) if len(chars) >= k else np.empty(0, np.uint64)
                word, mask = _place(h, bits)
                p = np.flatnonzero(t[word] & mask)
                doc = np.searchsorted(at, p, "right") - 1
                ok = p + k <= at[doc + 1]  # a shingle that spans two texts is none
                p, doc = p[ok], doc[ok]
                yield pa.RecordBatch.from_arrays([pa.array(h[p].view(np.int64)), pa.array(ids[doc], pa.int64()), pa.array(p - at[doc]), pa.array(at[doc + 1] - p)], names=["h", "doc_id", "at", "left"])

    return docs.mapInArrow(run, "h long, doc_id long, at long, left long")


def item_tokens(classes: DataFrame, counts: DataFrame, length: int, k: int) -> DataFrame:
    """(h, item_id, at, left): the rarest shingle of every window whose shingles all stand in some document."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = phrase_hashes(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), i, np.int64)), pa.array(np.arange(len(h)))], names=["h", "item_id", "at"])

    def rarest(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        c, h, w = g["n"].to_numpy(), g["h"].to_numpy(), length - k + 1
        view = np.lib.stride_tricks.sliding_window_view(c, w)
        first = np.unique(phrase_hashes(h.astype(np.uint32), w), return_index=True)[1]  # equal windows count once
        first = first[view[first].min(1) > 0]
        at = np.unique(first + view[first].argmin(1))
        return pd.DataFrame({"h": h[at], "item_id": g["item_id"].iloc[0], "at": at, "left": len(c) + k - 1 - at})

    s = classes.mapInArrow(shingles, "h long, item_id long, at long").join(counts, "h", "left").fillna(0, ["n"])
    return s.groupBy("item_id").applyInPandas(rarest, "h long, item_id long, at long, left long")


def _holds(length: int):
    """Whether the texts share ``length`` characters in a row along one of the offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, items = [], []
            for i, t, cand in zip(*(b.column(c).to_pylist() for c in range(3))):
                d, _ = reduced([t])
                found = set()
                for c in cand:
                    if c["item_id"] in found:
                        continue
                    e = np.frombuffer(c["chars"].encode("utf-32-le", "surrogatepass"), np.uint32)
                    x, y = max(0, -c["off"]), min(len(e), len(d) - c["off"])
                    bad = np.flatnonzero(np.r_[True, d[x + c["off"] : y + c["off"]] != e[x:y], True])
                    if (np.diff(bad) > length).any():
                        found.add(c["item_id"])
                docs += [i] * len(found)
                items += found
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, length: int = LENGTH, k: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, item_id): the documents that hold a passage of an item."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("length(text) > 0 and doc_id is not null")
    red = spool(reduced_items(items.filter("length(text) > 0 and item_id is not null")).filter(F.length("chars") >= length), "items")
    classes = red.groupBy("chars").agg(F.min("item_id").alias("item_id")).select("item_id", "chars")
    table = documents.sparkSession.sparkContext.broadcast(bit_table(classes, k, bits))
    shingles = spool(document_shingles(docs, table, k, bits), "shingles")
    tokens = item_tokens(classes, shingles.groupBy("h").agg(F.count("*").alias("n")), length, k)
    salted = tokens.select("h", F.col("item_id"), F.col("at").alias("_at"), F.col("left").alias("_left"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    cand = shingles.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(salted, ["h", "salt"])
    cand = cand.filter(F.least("at", "_at") + F.least("left", "_left") >= length)
    cand = cand.select("doc_id", "item_id", (F.col("at") - F.col("_at")).alias("off")).distinct()
    cand = cand.join(classes, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "off", "chars")).alias("cand"))
    got = docs.join(cand, "doc_id").select("doc_id", "text", "cand").mapInArrow(_holds(length), "doc_id long, item_id long").distinct()
    # Back to every item with that text.
    rep = red.join(classes.withColumnRenamed("item_id", "rep"), "chars").select("rep", "item_id").distinct()
    return got.withColumnRenamed("item_id", "rep").join(rep, "rep").select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: how many documents hold a passage of it (0 included)."""
    hits = leaked_passages(documents, items).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id", "kind", "split").join(hits, "item_id", "left").fillna(0, ["n_documents"])
