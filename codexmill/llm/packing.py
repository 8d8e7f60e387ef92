"""Filling containers of fixed capacity with texts, measured in tokens.

Method: swap-based local search. The items of one group are first placed best-fit
by falling size; then between any two containers an item moves, one is exchanged
for one, or two for one (either way round), always so that the sum of squared fills
grows, until no such exchange is left: containers that run empty are gone. The sum
is a bounded whole number, so the search ends.

Scale: an item is a row (text, first token, size). Items go into groups of some
``GROUP`` by hash of their id; a group is solved in one task. The items of containers
with more than ``slack`` tokens to spare are grouped anew at the next level, whose
input is a small share of the last one's, until one group is left or a level empties
less than the share ``LEAST`` of the containers it opened: by then regrouping has
nothing more to gain. Texts longer than a container fill whole containers; only their
rest is an item.

Defined results: null and empty texts hold no tokens and are in no container; every
token of every other text is in exactly one container; no container exceeds its
capacity; only texts over the capacity are split. Ties fall by size, then id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.session import spool

CAPACITY = 2048
#: Vocabulary of ranks of a public byte-level tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pattern by which the public byte-level vocabularies split text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items of one group, tokens a container may spare without being opened again, least share of containers that a level empties.
GROUP, SLACK, LEAST = 4000, 4, 0.001

_ENC: dict = {}


def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    if (path, pattern) not in _ENC:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENC[path, pattern] = tiktoken.Encoding("codexmill", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENC[path, pattern]


def token_counts(df: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens) of the texts that hold any."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(tokenizer, pattern)
        return texts.map(lambda t: len(enc.encode_ordinary(t)))

    return df.filter(F.length(text) > 0).select(key, count(text).alias("n_tokens"))


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item: by falling size, each into the fullest container that has room."""
    import bisect

    out = [0] * len(sizes)
    room: list[tuple[int, int]] = []  # (free, container), in order
    n = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        free, b = room.pop(at) if at < len(room) else (capacity, n)
        n = max(n, b + 1)
        out[i] = b
        if free > sizes[i]:
            bisect.insort(room, (free - sizes[i], b))
    return out


class Search:
    """Exchanges between the containers of one group.

    ``size`` and ``bin`` have a row for each item and, after these, one of size 0 for each container: an
    exchange for it is a move.
    """

    def __init__(self, sizes: list[int], bins: list[int], capacity: int):
        n = max(bins) + 1
        self.capacity, self.items = capacity, len(sizes)
        self.size = np.concatenate([np.array(sizes, np.int64), np.zeros(n, np.int64)])
        self.bin = np.concatenate([np.array(bins, np.int64), np.arange(n)])
        self.fill = np.bincount(self.bin, weights=self.size, minlength=n).astype(np.int64)
        self.held = [set() for _ in range(n)]
        for i, b in enumerate(bins):
            self.held[b].add(i)
        self.clock = 0
        self.changed = np.zeros(n, np.int64)  # when a container last changed
        self.tried = np.full(n, -1, np.int64)  # when it was last found without an exchange

    def offers(self, b: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        """Sizes that a container can give, in order, and the items: each size alone, and each two."""
        one = {int(self.size[i]): i for i in sorted(self.held[b], reverse=True)}
        out = {s: (i,) for s, i in one.items()}
        own = sorted(self.held[b])
        twice = {}
        for i in own:
            s = int(self.size[i])
            if one[s] != i:
                twice.setdefault(s, i)
        sizes = list(one)
        for x, s in enumerate(sizes):
            for t in sizes[x + 1 :]:
                out.setdefault(s + t, (one[s], one[t]))
            if s in twice:
                out.setdefault(2 * s, (one[s], twice[s]))
        keys = sorted(out)
        return np.array(keys, np.int64), [out[k] for k in keys]

    def improve(self, b: int) -> bool:
        """The exchange of this container that adds most to the squared fills, if any does."""
        fresh = self.changed[b] > self.tried[b]
        rows = np.flatnonzero((self.bin != b) & (self.fill[self.bin] > 0) & (fresh | (self.changed[self.bin] > self.tried[b])))
        if self.fill[b] == 0 or not len(rows):
            return False
        give, what = self.offers(b)
        size, fill = self.size[rows], self.fill[self.bin[rows]]
        best = None
        # What the other container gains: as much as it has room for; what it loses: as much as this one has.
        for at in (np.searchsorted(give, size + self.capacity - fill, "right") - 1, np.searchsorted(give, size - (self.capacity - self.fill[b]), "left")):
            ok = (at >= 0) & (at < len(give))
            d = give[np.clip(at, 0, len(give) - 1)] - size
            d[~ok | (fill + d > self.capacity) | (self.fill[b] - d > self.capacity)] = 0
            gain = d * (fill - self.fill[b] + d)
            r = int(gain.argmax())
            if gain[r] > 0 and (best is None or gain[r] > best[0]):
                best = (int(gain[r]), int(rows[r]), what[at[r]], int(d[r]))
        if best is None:
            return False
        _, j, items, d = best
        c = int(self.bin[j])
        self.clock += 1
        self.changed[b] = self.changed[c] = self.clock
        self.fill[b] -= d
        self.fill[c] += d
        for i in items:
            self.held[b].remove(i)
            self.held[c].add(i)
            self.bin[i] = c
        if j < self.items:
            self.held[c].remove(j)
            self.held[b].add(j)
            self.bin[j] = b
        return True

    def run(self) -> None:
        """Exchanges, from the emptiest container on, until none is left."""
        while True:
            todo = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity) & (self.tried < self.clock))
            if not len(todo):
                break
            for b in todo[np.argsort(self.fill[todo], kind="stable")].tolist():
                while self.improve(b):
                    pass
                self.tried[b] = self.clock


def pack(sizes: list[int], capacity: int, search: bool = True) -> list[int]:
    """Container number of each item; sizes are at most the capacity."""
    bins = best_fit(sizes, capacity)
    if search and bins:
        s = Search(sizes, bins, capacity)
        s.run()
        bins = np.unique(s.bin[: len(sizes)], return_inverse=True)[1].tolist()
    return bins


def _solve(key: str, capacity: int, level: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", key], ascending=[False, True], kind="stable").reset_index(drop=True)
        g["bin"] = pack(g["size"].tolist(), capacity)
        g["fill"] = g.groupby("bin")["size"].transform("sum")
        g["head"] = ~g.duplicated("bin")
        g["container_id"] = [f"{level}-{a}-{b}" for a, b in zip(g["grp"], g["bin"])]
        return g[[key, "first_token", "size", "container_id", "fill", "head"]]

    return run


def fill_containers(
    df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, pattern: str = PATTERN, group: int = GROUP, slack: int = SLACK, least: float = LEAST
) -> DataFrame:
    """(container_id, key, first_token, n_tokens): which tokens of which text each container holds."""
    counts = spool(token_counts(df, text, key, tokenizer, pattern), "tokens")
    full = counts.filter(f"n_tokens >= {capacity}").select(key, F.explode(F.sequence(F.lit(0), F.expr(f"n_tokens div {capacity} - 1"))).alias("part"))
    out = full.select(F.concat(F.lit("full-"), F.col(key).cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container_id"), key, (F.col("part") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"))
    items = counts.filter(f"n_tokens % {capacity} > 0").select(key, F.expr(f"n_tokens div {capacity} * {capacity}").alias("first_token"), F.expr(f"n_tokens % {capacity}").alias("size"))
    kind = df.schema[key].dataType.simpleString()
    n, level, before = items.count(), 0, None
    while n:
        groups = -(-n // group)
        placed = (
            items.withColumn("grp", F.pmod(F.xxhash64(key, F.lit(level)), F.lit(groups)))
            .groupBy("grp")
            .applyInPandas(_solve(key, capacity, level), f"`{key}` {kind}, first_token long, size long, container_id string, fill long, head boolean")
        )
        placed = spool(placed, "placed")
        spare = F.col("fill") < capacity - slack
        r = placed.agg(F.count_if("head").alias("bins"), F.count_if(F.col("head") & spare).alias("opened"), F.count_if(spare).alias("items")).first()
        last = groups == 1 or r.opened < 2 or before is not None and before - r.bins <= least * before
        done = placed if last else placed.filter(~spare)
        out = out.unionByName(done.select("container_id", key, "first_token", F.col("size").alias("n_tokens")))
        if last:
            break
        items, n, before, level = placed.filter(spare).select(key, "first_token", "size"), r["items"], r.opened, level + 1
    return out


def fill_report(df: DataFrame, capacity: int = CAPACITY, **kw) -> DataFrame:
    """(container_id, n_items, n_tokens, unused, containers, least_containers) of every container.

    ``containers``: how many there are in all; ``least_containers``: how many would do if nothing were left over.
    """
    c = fill_containers(df, capacity=capacity, **kw).groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    c = spool(c, "fill")
    t = c.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    return c.select("container_id", "n_items", "n_tokens", (F.lit(capacity) - F.col("n_tokens")).alias("unused"), F.lit(t.n).alias("containers"), F.lit(-(-t.t // capacity)).alias("least_containers"))
