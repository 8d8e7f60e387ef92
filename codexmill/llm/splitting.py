"""Cutting oversized texts at natural boundaries, by pointer doubling.

A cut is a position between two code points. From a cut the next piece starts at
the first natural boundary within the last ``overlap`` code points before it (the
cut itself if there is none) and ends at the farthest natural boundary within
``limit`` of that start, provided this lies beyond the cut; if the overlap leaves
no room, the piece starts at the cut; if there is still no boundary, it ends
``limit`` code points after the cut: a forced cut. The successor of every
boundary is found at once by binary search. The greedy chain of one text is then
read from successor tables squared log2(n) times (f, f∘f, f⁴ ...): all cuts of
all prefixes come out in parallel, without walking from cut to cut.

Defined results: null, empty and texts within the limit give no pieces (they need
none) in ``split_oversized``; a text of n > limit gives pieces that cover it
without gaps, each at most ``limit`` long, consecutive pieces sharing at most
``overlap`` code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks at which a text may be cut, beside white space.
MARKS = ". ! ? ; : , … | । ॥ ་ ༌ ། ༎ 。 ！ ？ ； ： ， 、 ｡ ､".split()
LIMIT, OVERLAP = 2000, 200


def boundaries(text: str) -> np.ndarray:
    """Cuts beside white space and marks, with 0 and len(text), in order."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = [c for c in set(text) if c in MARKS or c.isspace()]
    hit = np.flatnonzero(np.isin(a, np.array([ord(c) for c in chars], np.uint32)))
    return np.unique(np.concatenate([hit, hit + 1, [0, len(text)]]))


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, bool]:
    """Starts and ends of the pieces, and whether any cut was forced."""
    n = len(text)
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if n <= limit:
        return np.array([0]), np.array([n]), False
    nat = boundaries(text)
    # Forced cuts fall at multiples of the limit after a natural boundary whose gap is longer.
    gaps = np.diff(nat)
    wide = np.flatnonzero(gaps > limit)
    extra = [np.arange(nat[i] + limit, nat[i + 1], limit) for i in wide]
    cuts = np.unique(np.concatenate([nat, *extra])) if extra else nat

    def farthest(start: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        e = nat[np.searchsorted(nat, start + limit, "right") - 1]
        return np.where(e > beyond, e, -1)

    start = nat[np.searchsorted(nat, np.maximum(cuts - overlap, 0), "left")]
    start = np.where(cuts == 0, 0, np.minimum(start, cuts))
    end = farthest(start, cuts)
    tight = end < 0
    start = np.where(tight, cuts, start)
    end = np.where(tight, farthest(cuts, cuts), end)
    forced = end < 0
    end = np.where(forced, np.minimum(cuts + limit, n), end)
    nxt = np.searchsorted(cuts, end)
    nxt[-1] = len(cuts) - 1
    # Squaring: reach holds the first 2^k cuts of the chain; jump is f^(2^k).
    reach, jump = np.array([0]), nxt
    while reach[-1] != len(cuts) - 1:
        reach = np.concatenate([reach, jump[reach]])
        jump = jump[jump]
    at = np.unique(reach)[:-1]
    return start[at], end[at], bool(forced[at].any())


def split_oversized(
    df: DataFrame, text: str = "raw_text", keys: tuple[str, ...] = ("id", "segment_id", "sequence_no"), limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """Pieces of each text longer than ``limit``: keys, piece_no, start_char, end_char, piece, forced."""
    src = df.filter(F.length(text) > limit).select(*keys, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = b.drop(columns="_text")
            rows = []
            for i, t in enumerate(b["_text"]):
                s, e, forced = cut_points(t, limit, overlap)
                rows += [(i, k, int(x), int(y), t[x:y], forced) for k, (x, y) in enumerate(zip(s, e), 1)]
            out = pd.DataFrame(rows, columns=["_i", "piece_no", "start_char", "end_char", "piece", "forced"])
            yield keep.iloc[out.pop("_i")].reset_index(drop=True).join(out)

    return src.mapInPandas(run, f"{fields}, piece_no long, start_char long, end_char long, piece string, forced boolean")


def oversized(df: DataFrame, **kw) -> DataFrame:
    """(id, cut): the oversized records and whether their cuts fell at natural boundaries."""
    p = split_oversized(df, **kw).filter("piece_no = 1")
    return p.select("id", F.when(F.col("forced"), "forced").otherwise("natural").alias("cut"))
