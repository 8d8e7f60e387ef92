"""Texts decoded with the wrong encoding: finding and restoring them.

Method: smoothed character n-gram models, trained on the clean texts, score every
candidate encode-decode chain; the likeliest is taken if it beats the text as it
stands by a validated margin.

1. *Training*, over all texts without any trace of a wrong decoding: counts of
   code points, and of pairs of code points (outside ideographs) in a table of
   fixed size, summed in each task first. The model's size does not grow with the data.
2. *Traces.* A wrong decoding of UTF-8 leaves the image of a lead byte followed by
   that of a continuation byte, under some single-byte code; one of a double-byte
   code leaves runs of upper Latin-1 characters or C1 controls; a lossy one leaves
   replacement characters. One table lookup a character finds the texts with such
   traces; no other text can be changed by any chain.
3. *Chains.* For these texts each chain (encode with the code wrongly used, decode
   with the true one) is applied to every stretch it can be undone in. Chains
   follow one another as long as one is accepted, as in texts garbled twice or more.
4. *Choice.* The chain with the highest gain in log-likelihood is applied if the
   gain is over ``MARGIN`` nats for every place changed.
A text is garbled if a chain was applied, or if replacement characters or C1
controls remain (garbled, not restorable).

Defined results: null and empty texts are not garbled; a text restored in part
counts as garbled; ``restored`` is null unless something was changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes that texts are wrongly decoded with.
WRONG = ("latin-1", "cp1252", "cp1251", "cp1250", "cp437", "cp850", "cp866", "koi8-r", "mac_roman")
#: True codes beside UTF-8, and the codes they are mistaken for.
LEGACY, LEGACY_AS = ("gb18030", "big5", "shift_jis", "euc_jp", "euc_kr"), ("latin-1", "cp1252")
MARGIN = 4.0
PAIR_BITS = 18
CHUNK = 1_000_000
TOP = 0x110000


def _image(code: str) -> list[str]:
    """The characters of bytes 128-255; bytes without one pass as controls."""
    out = []
    for b in range(128, 256):
        try:
            out.append(bytes([b]).decode(code))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class Codes:
    """Tables of the wrong codes, built once a process."""

    _one: Codes | None = None

    def __init__(self) -> None:
        import re

        self.lead, self.cont = np.zeros(TOP, np.uint16), np.zeros(TOP, np.uint16)
        self.byte: dict[str, dict[int, int]] = {}
        self.one: dict[str, re.Pattern] = {}
        self.seq: dict[str, re.Pattern] = {}
        self.run: dict[str, re.Pattern] = {}
        for i, code in enumerate(WRONG):
            im = _image(code)
            back: dict[int, int] = {}
            for b, c in enumerate(im, 128):
                back.setdefault(ord(c), b)
                if 0xC2 <= b <= 0xF4:
                    self.lead[ord(c)] |= 1 << i
                if b < 0xC0:
                    self.cont[ord(c)] |= 1 << i
            for b in range(128, 160):  # C1 controls pass through where the code leaves a byte open
                back.setdefault(b, b)
            self.byte[code] = back
            cls = lambda lo, hi: "[" + "".join(re.escape(c) for c in im[lo - 128 : hi - 127]) + "]"
            k = cls(0x80, 0xBF)
            if code != "latin-1":
                k = k[:-1] + "\x80-\x9f]"
            one = f"(?:{cls(0xC2, 0xDF)}{k}|{cls(0xE0, 0xEF)}{k}{{2}}|{cls(0xF0, 0xF4)}{k}{{3}})"
            self.one[code], self.seq[code] = re.compile(one), re.compile(one + "+")
            allowed = "".join(re.escape(c) for c in im) + "\x80-\x9f"
            self.run[code] = re.compile(f"[\x20-\x7e{allowed}]*[{allowed}][\x20-\x7e{allowed}]*")

    @classmethod
    def get(cls) -> Codes:
        if cls._one is None:
            cls._one = cls()
        return cls._one

    def to_bytes(self, text: str, code: str) -> bytes:
        back = self.byte[code]
        return bytes(ord(c) if c < "\x80" else back[ord(c)] for c in text)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def traces(a: np.ndarray) -> np.ndarray:
    """Positions of traces of a wrong decoding among code points."""
    t = Codes.get()
    hit = _upper_run(a) | (a == 0xFFFD)
    if len(a) > 1:
        hit[:-1] |= (t.lead[a[:-1]] & t.cont[a[1:]]) != 0
    return np.flatnonzero(hit)


def _upper_run(a: np.ndarray) -> np.ndarray:
    """C1 controls, and where four upper Latin-1 characters stand in a row."""
    hit = (a >= 0x80) & (a < 0xA0)
    if len(a) > 3:
        high = (a >= 0xA0) & (a <= 0xFF)
        hit[:-3] |= high[:-3] & high[1:-2] & high[2:-1] & high[3:]
    return hit


def _chunks(texts: list) -> Iterator[tuple[int, int]]:
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= CHUNK or i + 1 == len(texts):
            yield first, i + 1
            first, n = i + 1, 0


def _suspects(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, text number of each, and whether each text has traces."""
    a = _points(texts)
    which = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    bad = np.zeros(len(texts), bool)
    bad[which[traces(a)]] = True
    return a, which, bad


def _pair(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = (p.astype(np.uint64) << np.uint64(21) | c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, two = np.zeros(TOP, np.int64), np.zeros(1 << PAIR_BITS, np.int64)
    for b in batches:
        texts = [t or "" for t in b.column(0).to_pylist()]
        for i, j in _chunks(texts):
            a, which, bad = _suspects(texts[i:j])
            ok = ~bad[which]
            a, which = a[ok], which[ok]
            one += np.bincount(a, minlength=TOP)
            p, c = a[:-1], a[1:]
            use = (which[:-1] == which[1:]) & (p < 0x2E80) & (c < 0x2E80)
            two += np.bincount(_pair(p[use], c[use]), minlength=1 << PAIR_BITS)
    x, y = np.flatnonzero(one), np.flatnonzero(two)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array([1, 2], np.int64), [len(x), len(y)])), pa.array(np.concatenate([x, y])), pa.array(np.concatenate([one[x], two[y]]))], names=["kind", "k", "n"]
    )


class Model:
    """Interpolated model of code points and their pairs."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        one, two = np.zeros(TOP, np.float64), np.zeros(1 << PAIR_BITS, np.float32)
        for kind, k, n in rows:
            (one if kind == 1 else two)[k] += n
        self.first = one.astype(np.float32)
        self.two, self.total = two, float(one.sum()) + TOP * 0.01

    def score(self, text: str) -> float:
        """Log-likelihood of all characters after the first."""
        if len(text) < 2:
            return 0.0
        a = _points([text])
        p, c = a[:-1], a[1:]
        uni = (self.first[c] + 0.01) / self.total
        both = (p < 0x2E80) & (c < 0x2E80)
        # Pairs share places in the table, so a pair can't count more than its first character.
        pair = np.where(both, np.minimum(self.two[_pair(p, c)], self.first[p]) / (self.first[p] + 20.0), uni)
        return float(np.log(0.3 * uni + 0.7 * pair).sum())


def train(texts: DataFrame) -> Model:
    """Model of the one text column of ``texts``; its rows number at most 2^18 plus the code points in use."""
    parts = texts.mapInArrow(_train, "kind long, k long, n long").groupBy("kind", "k").agg(F.sum("n").alias("n"))
    return Model([(r.kind, r.k, r.n) for r in parts.toLocalIterator()])


def _undo(seg: str, wrong: str, true: str) -> str | None:
    try:
        out = Codes.get().to_bytes(seg, wrong).decode(true)
    except (UnicodeDecodeError, KeyError):
        return None
    return None if any(c < " " and c not in "\n\t" for c in out) else out


def _gain(m: Model, text: str, x: int, y: int, new: str) -> float:
    before, after = text[max(0, x - 1) : x] or "\n", text[y : y + 1] or "\n"
    return m.score(before + new + after) - m.score(before + text[x:y] + after)


def best_chain(m: Model, text: str, margin: float = MARGIN) -> tuple[str, str] | None:
    """The likeliest chain's name and result, if its gain is over the margin."""
    t = Codes.get()
    best: tuple[float, str, str] | None = None
    # Only codes under which the text has a lead byte before a continuation byte, and
    # double-byte codes only where upper characters stand in a row, can be undone.
    a = _points([text])
    codes = int(np.bitwise_or.reduce(t.lead[a[:-1]] & t.cont[a[1:]])) if len(a) > 1 else 0
    rows = _upper_run(a).any()
    for i, wrong in enumerate(WRONG):
        tries = [("utf-8", t.seq[wrong])] if codes >> i & 1 else []
        if wrong in LEGACY_AS and rows:
            tries += [(true, t.run[wrong]) for true in LEGACY]
        for true, pattern in tries:
            gain, parts, at, twice = 0.0, [], 0, ""
            for s in pattern.finditer(text):
                x, y = s.span()
                if true != "utf-8" and sum(c > "\x7f" for c in s[0]) < 4:
                    continue
                new = _undo(s[0], wrong, true)
                if new is None and true == "utf-8":
                    # One false sequence among true ones: undo each by itself.
                    new = t.one[wrong].sub(lambda m: _undo(m[0], wrong, "utf-8") or m[0], s[0])
                    new = None if new == s[0] else new
                if new is None and true != "utf-8":
                    # A stretch may begin or end inside plain text: try its upper core.
                    x2 = x + next(i for i, c in enumerate(s[0]) if c > "\x7f")
                    if (new := _undo(text[x2:y], wrong, true)) is not None:
                        x = x2
                if new is None:
                    continue
                g = _gain(m, text, x, y, new)
                if true == "utf-8":
                    # A text garbled twice looks no better after one step: score the chain of two as well.
                    step = ""
                    for again in LEGACY_AS:
                        two = t.one[again].sub(lambda k: _undo(k[0], again, "utf-8") or k[0], new)
                        if two != new and (g2 := _gain(m, text, x, y, two)) > g:
                            g, new, step = g2, two, f">{again}>utf-8"
                if g > margin:
                    gain += g
                    twice = twice or (step if true == "utf-8" else "")
                    parts += [text[at:x], new]
                    at = y
            if parts and (best is None or gain > best[0]):
                best = (gain, f"{wrong}>{true}{twice}", "".join(parts) + text[at:])
    return best and (best[1], best[2])


def repair(m: Model, text: str, margin: float = MARGIN) -> tuple[list[str], str]:
    """Chains applied, and the text they lead to."""
    done: list[str] = []
    seen = {text}
    while len(traces(_points([text]))) and (b := best_chain(m, text, margin)) and b[1] not in seen:
        done.append(b[0])
        text = b[1]
        seen.add(text)
    return done, text


def _broken(text: str) -> bool:
    return any(c == "�" or "\x7f" < c < "\xa0" for c in set(text))


#: Clean texts on which a margin is validated.
HELD_OUT = 300


def validate_margin(texts: DataFrame, model: Model, margin: float = MARGIN, held_out: int = HELD_OUT) -> dict[str, float]:
    """How a margin does on texts garbled on purpose: a bounded sample of clean ones, by hash.

    found: share of the garbled texts in which a chain is applied; restored: share that
    comes back character by character; false: share of the clean texts that are changed.
    """
    col = texts.columns[0]
    rows = texts.filter(F.length(col) > 20).distinct().orderBy(F.xxhash64(col), col).limit(held_out)
    clean = [r[0] for r in rows.collect() if not len(traces(_points([r[0]])))]
    n = found = restored = 0
    for t in clean:
        for wrong in WRONG:
            im = _image(wrong)
            bad = "".join(im[b - 128] if b > 127 else chr(b) for b in t.encode("utf-8", "replace"))
            if bad != t:
                n += 1
                done, fixed = repair(model, bad, margin)
                found += bool(done)
                restored += fixed == t
    changed = sum(bool(best_chain(model, t, margin)) for t in clean)
    return {"garbled": n, "found": found / max(n, 1), "restored": restored / max(n, 1), "false": changed / max(len(clean), 1)}


def garbled_texts(df: DataFrame, text: str = "text", key: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """(key, chains, restorable, restored): the garbled texts."""
    model = df.sparkSession.sparkContext.broadcast(train(df.select(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            at, chains, good, new = [], [], [], []
            for i, j in _chunks(texts):
                _, _, bad = _suspects(texts[i:j])
                for k in i + np.flatnonzero(bad):
                    done, fixed = repair(m, texts[k], margin)
                    left = _broken(fixed)
                    if done or left:
                        at.append(k)
                        chains.append(" | ".join(done))
                        good.append(not left)
                        new.append(fixed if done else None)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(chains, pa.string()), pa.array(good, pa.bool_()), pa.array(new, pa.string())], names=[key, "chains", "restorable", "restored"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).filter(F.length(text) > 0).mapInArrow(run, f"`{key}` {kind}, chains string, restorable boolean, restored string")
