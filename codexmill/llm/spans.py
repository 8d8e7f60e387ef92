"""Long spans that stand verbatim in more than one record.

Method: repeated-phrase automata.
1. *Confirming.* Of each window of ``length`` code points the phrase of ``PHRASE``
   code points with the least hash is taken, the last one on ties. Equal windows
   choose equal phrases, so a shared window always holds a phrase that two records
   chose. Only (phrase hash, record) goes on, without positions, and is combined
   before the shuffle; a phrase that two records chose recurs.
2. *Compiling.* The recurring phrases are compiled, as text, into Aho-Corasick
   automata of some ``SHARD`` phrases. A phrase is in the shard of the record that
   first holds it, so phrases that travel together are located together, and copies of a
   text meet one shard. A record goes to the shards that hold one of its phrases; all
   records to all shards would cost records times shards. A shard that many records
   go to is compiled in several tasks, each with a part of them.
3. *Locating.* The whole texts of the records are streamed through the automaton,
   which locates every occurrence of the shard's phrases; positions come from nowhere
   else. A window belongs to the last phrase located in it: the windows of one
   occurrence are a segment of the text.
4. *Comparing.* Segments are compared as text. Where two records hold a whole segment,
   it is shared as it stands. What is left (at the borders of shared spans) is cut
   into its windows, and these are compared as text among each other and with one
   representative of every shared segment with that phrase.
5. Shared windows of a record that overlap or touch are merged.

No pairs are formed, and no group is collected. A record without any recurring
phrase cannot share a window and isn't streamed.

Defined results: null texts and texts under ``length`` share nothing; copies of
one text share all of it; a span repeated within one record only is no case, nor
between rows of one id; rows without an id are not compared; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexmill.session import spool

LENGTH, PHRASE = 80, 32
#: Tasks over which the records of one phrase are spread.
SALT = 8
#: Phrases of one automaton, on average, and records of one task that it is compiled for.
SHARD, PART = 20_000, 20_000
#: Code points hashed at once.
BLOCK = 2_000_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def phrase_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points from each position on, by doubling."""
    h, n, out, have = _mix((a.astype(np.uint64) + np.uint64(1)) * _M3), 1, None, 0
    while True:
        if k & n:
            if out is None:
                out = h.copy()
            else:
                m = len(h) - have
                out = _mix(out[:m] * _M1 + h[have : have + m])
            have += n
        if have == k:
            return out[: len(a) - k + 1]
        m = len(h) - n
        h = _mix(h[:m] * _M1 + h[n : n + m])
        n *= 2


def last_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least hash among w successive ones, the last on ties, for every window (van Herk's way)."""
    n = len(h)
    pad = -n % w
    # The lower bits give way to the position within a block pair, so that later ones win ties.
    a = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    pos = np.arange(a.size).reshape(-1, w)
    pre, pre_i = a.copy(), pos.copy()
    for j in range(1, w):
        less = pre[:, j - 1] < a[:, j]
        pre[:, j] = np.where(less, pre[:, j - 1], a[:, j])
        pre_i[:, j] = np.where(less, pre_i[:, j - 1], pos[:, j])
    suf, suf_i = a.copy(), pos.copy()
    for j in range(w - 2, -1, -1):
        less = a[:, j] < suf[:, j + 1]
        suf[:, j] = np.where(less, a[:, j], suf[:, j + 1])
        suf_i[:, j] = np.where(less, pos[:, j], suf_i[:, j + 1])
    m = n - w + 1
    s, p = suf.ravel()[:m], pre.ravel()[w - 1 : w - 1 + m]
    return np.where(s < p, suf_i.ravel()[:m], pre_i.ravel()[w - 1 : w - 1 + m])


def choose(texts: list[str], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chosen phrases of several texts: text number, position, hash, first and last window start that chose it."""
    joined = "".join(texts)
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(lens)])
    none = np.empty(0, np.int64)
    if len(a) < length:
        return none, none, none, none, none
    h = phrase_hashes(a, k)
    best = last_minima(h, length - k + 1)
    start = np.arange(len(best))
    which = np.repeat(np.arange(len(texts)), lens)[: len(best)]
    ok = start + length <= at[which + 1]
    best, start, which = best[ok], start[ok], which[ok]
    if not len(best):
        return none, none, none, none, none
    new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (which[1:] != which[:-1])])
    end = np.r_[new[1:] - 1, len(best) - 1]
    w, b = which[new], best[new]
    return w, b - at[w], h[b].view(np.int64), start[new] - at[w], start[end] - at[w]


def _blocks(texts: list, size: int) -> Iterator[tuple[int, int]]:
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _second_hash(joined: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k code points from each of some positions on, independent of the first."""
    mult = _mix(np.arange(1, k + 1, dtype=np.uint64) * _M1) | np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out += _mix((joined[at + j].astype(np.uint64) + np.uint64(j + 1)) * _M3) * mult[j]
    return out.view(np.int64)


def phrase_ids(texts: list[str], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chosen phrases of several texts: text number, position, and two hashes of the phrase."""
    w, p, h, _, _ = choose(texts, length, k)
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return w, p, h, _second_hash(a, at[w] + p, k)


def chosen_phrases(src: DataFrame, length: int, k: int) -> DataFrame:
    """(h, g, id): which record chose which phrase, by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_pylist()
            for i, j in _blocks(texts, BLOCK):
                w, _, h, g = phrase_ids(texts[i:j], length, k)
                _, one = np.unique(np.stack([w, h, g]), axis=1, return_index=True) if len(w) else (None, w)
                yield pa.RecordBatch.from_arrays([pa.array(h[one]), pa.array(g[one]), pa.array(ids[i:j][w[one]])], names=["h", "g", "id"])

    return src.mapInArrow(run, "h long, g long, id long")


def _deliver(length: int, k: int):
    """Records with their shards -> rows of the shards: the words a record gives its own shard (without id), and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, parts, ids, out = [], [], [], []
            for i, t, dest, own, shard, n in zip(*(b.column(c).to_pylist() for c in ("id", "text", "dest", "own", "own_shard", "own_parts"))):
                if own:
                    _, p, h, g = phrase_ids([t], length, k)
                    mine = {(x["h"], x["g"]) for x in own}
                    words = {t[q : q + k] for q, x, y in zip(p.tolist(), h.tolist(), g.tolist()) if (x, y) in mine}
                    for part in range(n):
                        shards += [shard] * len(words)
                        parts += [part] * len(words)
                        ids += [None] * len(words)
                        out += words
                for d in dest:
                    shards.append(d["shard"])
                    parts.append(d["part"])
                    ids.append(i)
                    out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(parts, pa.int64()), pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["shard", "part", "id", "text"])

    return run


def segments_of(text: str, auto, length: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, position of the phrase) of the segments of a text, by the phrases that the automaton locates."""
    spare, last = length - k, len(text) - length
    at = [e - k + 1 for e, _ in auto.iter(text)]
    for i, q in enumerate(at):
        lo, hi = max(0, q - spare), min(q, last)
        if i + 1 < len(at):
            hi = min(hi, at[i + 1] - spare - 1)
        if lo <= hi:
            yield lo, hi + length, q


def _stream(length: int, k: int):
    """Rows of the shards, words first -> segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        where, auto, ready = None, None, False
        for b in batches:
            shards, ids, starts, ats, out = [], [], [], [], []
            for shard, part, i, t in zip(*(b.column(c).to_pylist() for c in range(4))):
                if (shard, part) != where:
                    where, auto, ready = (shard, part), ahocorasick.Automaton(ahocorasick.STORE_LENGTH), False
                if i is None:
                    auto.add_word(t)
                    continue
                if not ready:
                    auto.make_automaton()
                    ready = True
                for x, y, q in segments_of(t, auto, length, k):
                    shards.append(shard)
                    ids.append(i)
                    starts.append(x)
                    ats.append(q - x)
                    out.append(t[x:y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ats, pa.int64()), pa.array(out, pa.string())], names=["shard", "id", "start", "at", "segment"]
            )

    return run


def located_segments(src: DataFrame, length: int, k: int, shard: int = SHARD, part: int = PART) -> DataFrame:
    """(shard, id, start, at, segment) of every occurrence of a recurring phrase in (id, text)."""
    chosen = spool(chosen_phrases(src, length, k), "phrases")
    recurring = spool(chosen.groupBy("h", "g").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("h", "g", "a"), "recurring")
    n_shards = max(1, -(-recurring.count() // shard))
    recurring = recurring.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(n_shards)))
    salted = recurring.select("h", "g", "shard", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    routes = chosen.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(salted, ["h", "g", "salt"]).select("id", "shard").distinct()
    routes = spool(routes, "routes")
    parts = routes.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(part)).cast("long").alias("parts"))
    dest = routes.join(parts, "shard").select("id", F.struct("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).alias("part")).alias("dest"))
    dest = dest.select("id", "dest", F.lit(None).cast("struct<h:bigint,g:bigint>").alias("own"), F.lit(None).cast("long").alias("own_shard"), F.lit(None).cast("long").alias("own_parts"))
    own = recurring.join(parts, "shard").select(F.col("a").alias("id"), F.lit(None).cast("struct<shard:bigint,part:bigint>").alias("dest"), F.struct("h", "g").alias("own"), F.col("shard").alias("own_shard"), F.col("parts").alias("own_parts"))
    info = dest.unionByName(own).groupBy("id").agg(F.collect_list("dest").alias("dest"), F.collect_list("own").alias("own"), F.max("own_shard").alias("own_shard"), F.max("own_parts").alias("own_parts"))
    rows = src.join(info, "id").select("id", "text", "dest", "own", "own_shard", "own_parts").mapInArrow(_deliver(length, k), "shard long, part long, id long, text string")
    rows = rows.repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("id").asc_nulls_first())
    return rows.mapInArrow(_stream(length, k), "shard long, id long, start long, at long, segment string")


def shared_windows(df: DataFrame, text: str = "raw_text", key: str = "id", length: int = LENGTH, k: int = PHRASE, **kw) -> DataFrame:
    """(id, start_char, end_char): ranges of shared windows, not yet merged."""
    src = df.filter((F.length(text) >= length) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    seg = spool(located_segments(src, length, k, **kw), "segments")

    whole = seg.groupBy("shard", "segment").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("at").alias("at"))
    whole = spool(whole.select("shard", "segment", F.expr(f"substring(segment, cast(at + 1 as int), {k})").alias("phrase"), (F.col("a") != F.col("b")).alias("shared")), "whole")
    full = seg.join(whole.filter("shared").select("shard", "segment"), ["shard", "segment"], "left_semi")
    full = full.select("id", F.col("start").alias("start_char"), (F.col("start") + F.length("segment")).alias("end_char"))

    # Borders: single segments; of each shared segment with the phrase of one, a representative.
    alone = whole.filter("not shared")
    single = seg.join(alone.select("shard", "segment"), ["shard", "segment"], "left_semi").select("id", "start", "segment")
    reps = whole.filter("shared").join(alone.select("shard", "phrase").distinct(), ["shard", "phrase"], "left_semi")
    reps = reps.select(F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("start"), "segment")
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("segment") - (length - 1)), lambda i: F.substring("segment", i, F.lit(length)))).alias("i", "w")
    win = single.unionByName(reps).select("id", "start", at)
    win = spool(win.select("id", (F.col("start") + F.col("i")).alias("start_char"), F.xxhash64("w").alias("x"), "w"), "windows")
    # Where all windows of one hash are one text, the hash stands for it. A representative counts as two records.
    def forms(w: DataFrame) -> DataFrame:
        g = w.groupBy("x", "w").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count_if(F.col("id").isNull()).alias("r"))
        return g.select("x", "w", F.expr("a is not null and (a <> b or r > 0)").alias("hit"))

    hashes = spool(forms(win).groupBy("x").agg(F.count("*").alias("texts"), F.bool_or("hit").alias("hit")).filter("hit").select("x", "texts"), "hashes")
    border = win.join(hashes.filter("texts = 1"), "x", "left_semi")
    if not hashes.filter("texts > 1").isEmpty():
        clash = win.join(hashes.filter("texts > 1"), "x", "left_semi")
        border = border.unionByName(clash.join(forms(clash).filter("hit").select("x", "w"), ["x", "w"], "left_semi"), allowMissingColumns=True)
    border = border.select("id", "start_char").filter("id is not null")
    return full.unionByName(border.select("id", "start_char", (F.col("start_char") + length).alias("end_char")))


def merge_ranges(df: DataFrame) -> DataFrame:
    """Ranges (id, start_char, end_char) that overlap or touch become one."""
    w = Window.partitionBy("id").orderBy("start_char", "end_char")
    reach = F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.distinct().withColumn("_new", F.when(reach.isNull() | (F.col("start_char") > reach), 1).otherwise(0))
    df = df.withColumn("_run", F.sum("_new").over(w))
    return df.groupBy("id", "_run").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).drop("_run")


def shared_spans(df: DataFrame, text: str = "raw_text", key: str = "id", length: int = LENGTH, k: int = PHRASE, **kw) -> DataFrame:
    """(id, start_char, end_char) of the merged stretches that another record holds too."""
    return merge_ranges(shared_windows(df, text, key, length, k, **kw)).select("id", "start_char", "end_char")


def shared_report(df: DataFrame, text: str = "raw_text", key: str = "id", **kw) -> DataFrame:
    """(id, witness, n_spans, shared_chars, n_chars): how much of each record stands elsewhere too."""
    per = shared_spans(df, text, key, **kw).groupBy("id").agg(F.count("*").alias("n_spans"), F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    base = df.select(F.col(key).alias("id"), "witness", F.length(text).cast("long").alias("n_chars"))
    return base.join(per, "id").select("id", "witness", "n_spans", "shared_chars", "n_chars")
