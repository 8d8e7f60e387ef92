"""Identifiers, keys, digests and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of work ids and line keys (ignoring case).
WORK_ID = r"(?i)^([A-Za-z]{1,4})(\d{1,3})n(\d{4,5}[a-z]?)$"
_L = r"(\d{3,4})([a-c])(\d{1,2})([a-z]?)"
LINE = rf"(?i)^{_L}$"
RANGE = rf"(?i)^([^:]+):{_L}(?:\.\.{_L})?$"


def _pad(c: Column, n: int) -> Column:
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def work_from_segment(c: Column) -> Column:
    """Text before the first ``:`` and then the first ``#``; null for null or empty."""
    return F.when(c.isNotNull() & (c != ""), F.substring_index(F.substring_index(c, ":", 1), "#", 1))


def normalize_work_id(c: Column, pattern: str = WORK_ID) -> Column:
    """Collection upper case, volume two digits, ``n``, number lower case; null if of another shape."""
    t = F.btrim(c)
    p = lambda i: F.regexp_extract(t, pattern, i)
    return F.when(t.rlike(pattern), F.concat(F.upper(p(1)), _pad(p(2), 2), F.lit("n"), F.lower(p(3))))


def _line(c: Column, pattern: str, i: int) -> Column:
    """The line whose four parts are the groups of a pattern from i on, padded to equal width."""
    p = lambda k: F.regexp_extract(c, pattern, i + k)
    return F.lower(F.concat(F.lpad(p(0), 4, "0"), p(1), F.lpad(p(2), 2, "0"), p(3)))


def normalize_line(c: Column) -> Column:
    """Page four digits, column letter, line two digits, suffix; null if of another shape.

    Normalized lines compare as their keys (page, column, line, suffix) do.
    """
    t = F.regexp_replace(F.btrim(c), "^[tT]+", "")
    return F.when(t.rlike(LINE), _line(t, LINE, 1))


def line_key(c: Column) -> Column:
    """Comparable key of a line: (page, column, line, suffix)."""
    n = normalize_line(c)
    part = F.substring
    return F.when(n.isNotNull(), F.struct(part(n, 1, 4).cast("int").alias("page"), (F.ascii(part(n, 5, 1)) - 97).alias("col"), part(n, 6, 2).cast("int").alias("line"), part(n, 8, 1).alias("suffix")))


def parse_identifier(c: Column, work=None) -> Column:
    """struct(work, start, end) of ``work``, ``work:line`` or ``work:line..line``; null if invalid or reversed.

    ``work`` normalizes the work part (None: any id without a colon, as it stands).
    """
    norm = work or (lambda x: F.when((x != "") & ~x.contains(":"), x))
    is_range = c.rlike(RANGE)
    w = norm(F.when(is_range, F.regexp_extract(c, RANGE, 1)).otherwise(c))
    start = F.when(is_range, _line(c, RANGE, 2))
    end = F.when(is_range & (F.regexp_extract(c, RANGE, 6) != ""), _line(c, RANGE, 6)).otherwise(start)
    return F.when(w.isNotNull() & (~is_range | (start <= end)), F.struct(w.alias("work"), start.alias("start"), end.alias("end")))


def record_interval(work_id: Column, segment_id: Column, relation_ids: Column, work=None) -> Column:
    """struct(lo, hi, locator) of the lines a record covers; null if it names none.

    First and last of two or more relation ids come before the segment id; both must
    name the record's own work.
    """
    norm = work or (lambda x: x)
    own = norm(work_id)
    first, last = parse_identifier(F.try_element_at(relation_ids, F.lit(1)), work), parse_identifier(F.try_element_at(relation_ids, F.lit(-1)), work)
    seg = parse_identifier(segment_id, work)
    # One struct a source, so that what is parsed is written down once.
    span = lambda lo, hi, name: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(name).alias("locator"))
    both = F.when(F.size(relation_ids) >= 2, F.array(first, last))
    by_rel = F.element_at(F.transform(F.array(both), lambda b: F.when((b[0]["work"] == own) & (b[1]["work"] == own) & (b[0]["start"] <= b[1]["end"]), span(b[0]["start"], b[1]["end"], "relation_ids"))), 1)
    by_seg = F.element_at(F.transform(F.array(seg), lambda x: F.when((x["work"] == own) & x["start"].isNotNull(), span(x["start"], x["end"], "segment_id"))), 1)
    return F.coalesce(by_rel, by_seg)


def bucket(c: Column) -> Column:
    """First two hex digits of the SHA-256 of a key."""
    return F.substring(F.sha2(c, 256), 1, 2)


def git_blob_sha(content: Column) -> Column:
    """SHA-1 under which git stores the content."""
    body = F.encode(content, "UTF-8")
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(body).cast("string")), "UTF-8")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), body))


def is_sha(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{40}$")


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def relative_path(path: Column, prefix: str) -> Column:
    """Path below a root; null outside it."""
    p = prefix.rstrip("/") + "/"
    return F.when(path.startswith(p) & (F.length(path) > len(p)), F.substring(path, len(p) + 1, 1_000_000))


def path_in_repository(path: Column, root: Column) -> Column:
    """Path below the folder of a repository; one that is empty or outside is an error."""
    head = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    outside = F.raise_error(F.concat(F.lit("path is outside its repository: "), F.coalesce(path, F.lit("null"))))
    return F.when(path.startswith(head) & (F.length(path) > F.length(head)), F.substring(path, F.length(head) + 1, F.length(path))).otherwise(outside)


def valid_path(c: Column) -> Column:
    """A relative POSIX path without empty, ``.`` or ``..`` parts, backslash, colon or NUL."""
    return (
        c.isNotNull() & (c != "") & ~c.startswith("/") & ~c.rlike(r"[\\:\x00]") & ~c.rlike(r"(^|/)(\.{0,2})(/|$)")
    )


def content_id(*cols: Column, names: list[str]) -> Column:
    """SHA-256 of a JSON object with sorted keys; nulls are kept."""
    pairs = sorted(zip(names, cols), key=lambda x: x[0])
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in pairs]), {"ignoreNullFields": "false"}), 256)


def evidence_id(*cols: Column, names: list[str]) -> Column:
    return F.concat(F.lit("e-"), F.substring(content_id(*cols, names=names), 1, 24))


def fragment_bytes(name: str, c: Column) -> Column:
    """UTF-8 bytes of ``"name":value`` in JSON."""
    return F.octet_length(F.to_json(F.struct(c.alias(name)), {"ignoreNullFields": "false"})) - 2


def aware_timestamp(c: Column) -> Column:
    """Timestamp of an ISO text with an offset; null without one."""
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))
