"""Frequency of every distinct term, with marks for the useless ones.

Method: each task counts the terms of its records in a hash table (occurrences
and records that hold the term), flushes the table when it has grown to a set
size, and only these partial sums are shuffled, by hash of the term. A term
that a third of all records hold is thus one row a flush, not one a record.

Defined results: null and empty texts hold no terms; terms are compared as they
stand; a record counts once for a term however often it repeats it; an empty
table gives no rows. A field may be limited to rows that meet a condition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term: a maximal run of letters, marks and numbers.
TERM = r"[\p{L}\p{M}\p{N}]+"
#: Distinct terms that a task holds before it passes its partial sums on.
FLUSH_TERMS = 300_000

_SCHEMA = "field string, term string, occurrences long, records long"


def _partial_counts(fields: list[str], flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import regex

        find = regex.compile(TERM).findall
        occ = {f: Counter() for f in fields}
        rec = {f: Counter() for f in fields}

        def rows(f: str) -> pa.RecordBatch:
            terms = list(occ[f])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([f] * len(terms), pa.string()),
                    pa.array(terms, pa.string()),
                    pa.array([occ[f][t] for t in terms], pa.int64()),
                    pa.array([rec[f][t] for t in terms], pa.int64()),
                ],
                names=["field", "term", "occurrences", "records"],
            )
            occ[f].clear()
            rec[f].clear()
            return out

        for b in batches:
            for f in fields:
                o, r = occ[f], rec[f]
                for text in b.column(f).to_pylist():
                    if text:
                        terms = find(text)
                        o.update(terms)
                        r.update(set(terms))
                if len(o) > flush:
                    yield rows(f)
        for f in fields:
            if occ[f]:
                yield rows(f)

    return run


def term_counts(df: DataFrame, fields: dict[str, Column | None], flush: int = FLUSH_TERMS) -> DataFrame:
    """(field, term, occurrences, records) of the named text columns of ``df``.

    fields: column -> condition its rows must meet (None: all rows).
    """
    cols = [(F.when(c, F.col(f)) if c is not None else F.col(f)).alias(f) for f, c in fields.items()]
    part = df.select(*cols).mapInArrow(_partial_counts(list(fields), flush), _SCHEMA)
    return part.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, n_rows: int, common_share: float = 0.05, rare_records: int = 2) -> DataFrame:
    """``counts`` with ``mark``: common (held by at least that share of all rows), else rare, else null."""
    # A quotient is rounded like the literal, a product need not be: 0.05 * 140 is over 7.
    mark = F.when(F.col("records") / F.lit(max(n_rows, 1)) >= F.lit(common_share), "common").when(F.col("records") <= rare_records, "rare")
    return counts.withColumn("mark", mark)


#: Languages whose norm_text is divided by spaces.
SPACED = ("pli", "san", "en", "de", "vi")


def record_terms(records: DataFrame) -> DataFrame:
    """Terms of lemma_text (all rows) and norm_text (rows of spaced languages), marked."""
    counts = term_counts(records, {"lemma_text": None, "norm_text": F.col("language").isin(*SPACED)})
    return mark_terms(counts, records.count())
