"""Sentence boundaries across languages and scripts.

Method: a linear-chain model tags positions as boundary or inside, and Viterbi
decoding finds the best tagging of a whole text.

*Punctuated text.* Only a closing mark can be followed by a boundary, so the chain
runs over the closing marks (with the quotes and verse numbers that belong to
them); all other characters have probability 0. The emissions are learned from the
corpus without labels. The ends of texts are sure sentence ends, so a kind of mark
(a full stop after a given token, after an initial, after a number; omission
points) ends sentences as often as it ends texts, measured against question and
exclamation marks of the same language: ``vol.`` never ends a text, ``etc.`` does
like any word. What follows a mark (a capital, a small letter, a digit) is weighed by
how often it follows question and exclamation marks, and how often this token where
it does not end a sentence (a few rounds of expectation and maximization a token, from
the pool of all such tokens). Transitions are learned from successive marks whose state
is known beforehand: initials and abbreviations come in rows. What cannot be a
boundary has probability 0: marks inside quotes and brackets, marks inside tokens, marks
before a comma, a closed quotation before lower case, omission points other than before a
capital or at the end in English and Vietnamese; nor does a sentence consist of marks.

*Unpunctuated Chinese.* The chain runs over all characters. Transitions and emissions
- the character, and whether the layout breaks after it, by a line break or a wide
space - are learned from the punctuated Chinese texts, whose closing marks are replaced
by breaks of layout and whose other punctuation is stripped.

Language is taken from script and letters; the label decides only where these leave
it open. Characters are read in their plain width, invisible ones are passed over.

Defined results: null, empty and blank texts have no sentences; a text without any
closing mark is one sentence (Chinese: one per line or piece between wide spaces).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations known beforehand (initials, and in German ordinals, among them), as pseudo-counts that the corpus may outweigh.
KNOWN = {
    "en": "vol no p pp cf st ed dr ven ch fol ca i.e e.g mr mrs prof sr jr fig <initial>".split(),
    "de": "vgl bzw s bd hrsg nr d.h u.a z.b ca dr prof <initial> <number>".split(),
    "vi": "q tr tk v.v <initial>".split(),
    "indic": "ka do ro ms p fol <initial>".split(),
}
KNOWN_WEIGHT = 40
#: A token is judged on its own once it should have ended this many texts, and ended fewer by so many standard deviations.
SURE, SPREAD = 8.0, 3.0
FLUSH = 200_000
#: What a token without counts of its own does; what most a token is trusted to end sentences.
USUAL, MOST = 0.99, 0.99
#: Marks that the pooled counts of what follows stand for in a token's own, and rounds of learning these.
POOLED, ROUNDS = 10.0, 30
#: Transitions that the pool of all states stands for.
STEPS = 20.0
NEXT = ("upper", "lower", "digit", "other")

OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "‘": "’", "(": ")", "[": "]", "{": "}", "《": "》", "〈": "〉", '"': '"'}
CLOSE = set("”»›」』’)]}》〉“\"")
MARKS = set(".!?。।॥|༎…")
#: Spaces as wide as an ideograph.
WIDE = set("\u3000\u2003\u2001")

_RE: dict = {}


def _re() -> dict:
    if not _RE:
        import regex as re

        _RE["scan"] = re.compile(r"\.{2,}|…+|[.!?。]+|[।॥|]+|༎|།\s*།|[༄༅]+(?:\s*།){0,2}|[“”„«»‹›「」『』‘’()\[\]{}《》〈〉\"]")
        _RE["verse"] = re.compile(r"\s*[0-9०-९༠-༩]+\s*[।॥|]+")
        _RE["token"] = re.compile(r"[\p{L}\p{M}\p{N}.]+$")
        _RE["next"] = re.compile(r"(\s*)[“„«‹「『‘(\[\"]*(\S?)")
        _RE["word"] = re.compile(r"[\p{L}\p{N}]")
        _RE["odd"] = re.compile(r"[\p{Cf}\p{Zs}！-￮ɡɑͰ-֏ἀ-῿]")
        _RE["cjkmark"] = re.compile(r"[。.!?]")
        _RE["cjk"] = re.compile(r"[\p{Han}]")
        _RE["strip"] = re.compile(r"[\p{P}\p{S}]+")
    return _RE


def simplify(text: str) -> tuple[str, list[int] | None]:
    """Text in plain width and Latin look-alikes without invisible characters, and where its characters come from."""
    import unicodedata as u

    from codexmill.llm.lookalike import DOUBLES

    if text.isascii() or not _re()["odd"].search(text):
        return text, None
    table: dict[int, str] = {}
    gone = False
    for c in set(text):
        if u.category(c) == "Cf":
            gone = True
        elif c not in WIDE and len(n := DOUBLES.get(c) or u.normalize("NFKC", c)) == 1 and n != c:
            table[ord(c)] = n
    if not gone:
        return text.translate(table), None
    at = [i for i, c in enumerate(text) if u.category(c) != "Cf"]
    return "".join(text[i] for i in at).translate(table), at


VI = set("ăđơư") | {chr(c) for c in range(0x1EA0, 0x1EFA)}
INDIC = set("āīūṃṅñṭḍṇḷṛṝṣśḥṁ")
DE = set("äöüß")


def language_of(text: str, label: str | None) -> str:
    """One of zh, bo, deva, vi, de, en, indic."""
    import unicodedata as u
    from collections import Counter

    n = Counter()
    if text.isascii():
        letters = 1
    else:
        letters = 0
        for c, k in Counter(u.normalize("NFC", text).lower()).items():
            if not c.isalpha():
                continue
            letters += k
            if "ༀ" <= c <= "࿿":
                n["bo"] += k
            elif "ऀ" <= c <= "ॿ":
                n["deva"] += k
            elif c >= "⺀":
                n["zh"] += k
            elif c in VI:
                n["vi"] += k
            elif c in INDIC:
                n["indic"] += k
            elif c in DE:
                n["de"] += k
    for g in ("zh", "bo", "deva"):
        if n[g] > 0.4 * letters:
            return g
    share = {g: n[g] / max(letters, 1) for g in ("vi", "indic", "de")}
    if share["vi"] >= 0.04 and share["vi"] >= share["indic"]:
        return "vi"
    if share["indic"] >= 0.02:
        return "indic"
    if share["de"] >= (0.015 if label == "en" else 0.006):
        return "de"
    if label == "de" or (label in ("pli", "san", "vi") and letters < 40):
        return {"pli": "indic", "san": "indic"}.get(label, label)
    return "en"


def marks(s: str, lang: str) -> list[tuple[int, str, str, str]]:
    """Closing marks outside quotes and brackets: (end, kind, token, next).

    kind: stop, mark, dots, danda, shad, quoted; next: end, upper, lower, digit, other, punct, joined.
    """
    rx = _re()
    out: list[tuple[int, str, str, str]] = []
    stack: list[str] = []
    n = len(s)
    done = 0
    for m in rx["scan"].finditer(s):
        c, x, y = m[0], m.start(), m.end()
        if x < done:
            continue
        if c[0] in CLOSE or c[0] in OPEN:
            if stack and c in stack[-1]:
                stack.pop()
                if not stack and x and s[x - 1] in MARKS and c not in ")]}":
                    if s[x - 1] == "…" or s[x - 3 : x] == "...":
                        out.append((y, "dots", "", _next(s, y)))
                    else:
                        out.append((y, "quoted", "", _next(s, y)))
            elif c in OPEN:
                if c == "‘" and y < n and not s[y].isalnum():
                    continue
                # An opener of the kind that is open already shows that the first was never closed.
                if any(s.find(q, y) >= 0 for q in OPEN[c]) and not (c not in "([{" and stack and stack[-1] == OPEN[c]):
                    stack.append(OPEN[c])
            elif out and out[-1][0] == x and c not in "’":
                e, kind, tok, _ = out[-1]
                out[-1] = (y, kind, tok, _next(s, y))
            continue
        if stack or c[0] in "༄༅":
            continue
        if c[0] == "…" or c.startswith(".."):
            out.append((y, "dots", "", _next(s, y)))
        elif c == ".":
            t = rx["token"].search(s, max(0, x - 14), x)
            out.append((y, "stop", t[0] if t else "", _next(s, y)))
        elif c[0] in "।॥|":
            v = rx["verse"].match(s, y)
            if v:
                y = done = v.end()
            out.append((y, "danda", "", _next(s, y)))
        elif c[0] in "༎།":
            out.append((y, "shad", "", _next(s, y)))
        else:
            out.append((y, "mark", "", _next(s, y)))
    return out


def _next(s: str, y: int) -> str:
    m = _re()["next"].match(s, y)
    c = m[2]
    if not c:
        return "end"
    if not m[1] and y < len(s) and c.isalnum() and m.end() == y + 1 and c < "⺀" and not "ༀ" <= c <= "࿿" and not "ऀ" <= c <= "ॿ":
        return "joined"
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    if c.isdigit():
        return "digit"
    return "punct" if c in ",;:、，；：)]}…" else "other"


def kind_key(kind: str, token: str) -> str:
    """What a mark's emission is learned for: a token, or a pooled class (in angle brackets)."""
    if kind != "stop":
        return f"<{kind}>"
    t = token.rstrip(".")
    if len(t) == 1 and t.isupper():
        return "<initial>"
    if t.replace(".", "").isdigit():
        return "<number>"
    return t.lower() if t and len(t) <= 12 else "<word>"


class Emissions:
    """What is learned: P(boundary) of each kind of mark and of what follows it, transitions, and the chain of Chinese characters.

    rows: (language, kind, marks, of which at the end of a text, of the others: followed by each of NEXT). Kinds ``<after:xy>`` count
    transitions from x to y (i: inside, b: boundary). zh: of each character, how often it stood before a boundary and inside. zh_after:
    the same transitions between the characters.
    """

    def __init__(self, rows: list[tuple], zh: dict[str, tuple[int, int]], zh_after: dict[str, int] | None = None):
        import numpy as np

        total = {(r[0], r[1]): np.array([*r[2:], *[0] * (8 - len(r))][:6], float) for r in rows}
        self.p: dict[tuple[str, str], dict[str, float]] = {}
        self.step: dict[str, list[list[float]]] = {}
        for g in ("vi", "de", "en", "indic", "zh", "bo", "deva"):
            ref = total.get((g, "<ref>"), np.zeros(6))
            rate = (ref[1] + 2) / (ref[0] + 10)
            for w in KNOWN.get(g, ()):
                total[g, w] = total.get((g, w), np.zeros(6)) + [KNOWN_WEIGHT, 0, 0, 0, 0, 0]
            share = {}
            for (h, k), c in total.items():
                if h == g and k not in ("<ref>", "<word>") and not k.startswith("<after"):
                    prior = 2.0  # a mark ends a sentence unless shown otherwise
                    p = min(MOST, (c[1] / rate + prior * 0.9) / (c[0] + prior))
                    x = c[0] * rate
                    if k[0] == "<" or x >= SURE and c[1] < x - SPREAD * math.sqrt(x * (1 - rate)) or k in KNOWN.get(g, ()):
                        share[k] = max(p, 1e-4)
            ends = (ref[2:] + 1) / (ref[2:].sum() + len(NEXT))
            inner = sum((total[g, k][2:] for k, p in share.items() if p < 0.1 and k != "<dots>"), np.ones(len(NEXT)))
            inner /= inner.sum()
            for k, p0 in share.items():
                own, p, seen, sure = inner, p0, total[g, k][2:], total[g, k][0] * rate
                for _ in range(ROUNDS):
                    b = p * ends / (p * ends + (1 - p) * own)
                    p = min(MOST, max(1e-4, ((seen * b).sum() + sure * p0) / (seen.sum() + sure)))
                    own = POOLED * inner + seen * (1 - b)
                    own = own / own.sum()
                b = p * ends / (p * ends + (1 - p) * own)
                self.p[g, k] = dict(zip(NEXT, b.tolist())) | {"": float(p0)}
            b = USUAL * ends / (USUAL * ends + (1 - USUAL) * inner)
            self.p[g, "<usual>"] = dict(zip(NEXT, b.tolist())) | {"": USUAL}
            self.step[g] = self._steps({k[7:9]: c[0] for (h, k), c in total.items() if h == g and k.startswith("<after")}, relative=True)
        m = sum(b for b, _ in zh.values()) + 1.0
        o = sum(i for _, i in zh.values()) + 1.0
        self.layout = (math.log((m + 0.5) / (m + 1)) - math.log(0.5 / (o + 1)), math.log(0.5 / (m + 1)) - math.log((o + 0.5) / (o + 1)))
        self.zh = {c: math.log((b + 0.5) / (m + 500)) - math.log((i + 0.5) / (o + 500)) for c, (b, i) in zh.items()}
        self.zh_step = self._steps(zh_after or {}, relative=False)

    @staticmethod
    def _steps(n: dict[str, float], relative: bool) -> list[list[float]]:
        """Logs of P(to | from), or of how much more likely that makes the state than it is on the whole."""
        of = [sum(n.get(x + y, 0.0) for x in "ib") + 1.0 for y in "ib"]
        of = [x / sum(of) for x in of]
        c = [[n.get(x + y, 0.0) + STEPS * of[j] for j, y in enumerate("ib")] for x in "ib"]
        return [[math.log(r[j] / sum(r) / (of[j] if relative else 1.0)) for j in (0, 1)] for r in c]

    def boundary(self, lang: str, kind: str, token: str, nxt: str) -> float:
        if nxt == "end":
            return 1.0
        if nxt in ("joined", "punct"):
            return 0.0
        if kind == "dots":
            return self.p.get((lang, "<dots>"), {"": 0.9})[""] if lang in ("en", "vi") and nxt == "upper" else 0.0
        if kind == "quoted":
            return 0.0 if nxt == "lower" else 0.95
        if kind in ("danda", "shad", "mark"):
            return 0.98
        p = self.p.get((lang, kind_key(kind, token))) or self.p.get((lang, "<usual>"), {})
        return p.get(nxt, p.get("", USUAL))


def viterbi(emit: list[float], linked: list[bool], step: list[list[float]]) -> list[bool]:
    """Best tagging of a chain.

    emit: P(boundary). step: log weight from a state to the next (0 inside, 1 boundary). ``linked[i]``:
    nothing to read between mark i-1 and i, so not both are boundaries, and of two the later one ends the sentence.
    """
    lo = 1e-9
    best = [0.0, -math.inf]
    back: list[tuple[int, int]] = []
    for n, (p, tie) in enumerate(zip(emit, linked)):
        go = step if n and not tie else ((0.0, 0.0), (0.0, 0.0))
        i = [best[x] + go[x][0] for x in (0, 1)]
        b = [best[x] + go[x][1] for x in (0, 1)]
        i_from = 0 if i[0] > i[1] else 1
        b_from = 0 if tie or b[0] > b[1] else 1
        back.append((i_from, b_from))
        best = [i[i_from] + math.log(max(1 - p, lo)), b[b_from] + math.log(max(p, lo))]
    s = 0 if best[0] > best[1] else 1
    out = []
    for b in reversed(back):
        out.append(bool(s))
        s = b[s]
    return out[::-1]


def _chinese_breaks(s: str, em: Emissions) -> list[int]:
    """Boundaries of unpunctuated Chinese, by a chain over its characters."""
    ends, emit = [], []
    for i, c in enumerate(s):
        if not c.isspace():
            # An end of line or a wide space, be there blanks before it.
            j = i + 1
            while j < len(s) and s[j].isspace() and s[j] not in "\n\r" and s[j] not in WIDE:
                j += 1
            broken = j < len(s) and s[j].isspace()
            ends.append(i + 1)
            emit.append(1 / (1 + math.exp(-(em.zh.get(c, 0.0) + em.layout[0 if broken else 1]))))
    return [e for e, b in zip(ends, viterbi(emit, [False] * len(emit), em.zh_step)) if b]


def sentences(text: str, label: str | None, em: Emissions) -> list[tuple[int, int]]:
    """Spans [start, end) of the sentences of a text."""
    if not text or text.isspace():
        return []
    rx = _re()
    s, at = simplify(text)
    lang = language_of(s, label)
    if lang == "zh" and not rx["cjkmark"].search(s):
        cuts = _chinese_breaks(s, em)
    else:
        cand = [(e, p) for e, k, t, n in marks(s, lang) if (p := em.boundary(lang, k, t, n)) > 0]
        emit = [p for _, p in cand]
        linked, prev, read = [], 0, False
        for i, (e, _) in enumerate(cand):
            linked.append(not rx["word"].search(s, prev, e))
            read |= not linked[-1]
            if not read:  # marks before any word belong to the first sentence
                emit[i] = 0.0
            prev = e
        cuts = [e for (e, _), b in zip(cand, viterbi(emit, linked, em.step[lang])) if b]
    out, a, n = [], 0, len(text)
    for e in [*cuts, None]:
        if e is None:
            z = n
        else:
            z = e if at is None else at[e - 1] + 1
            while z < n and at is not None and not text[z].isspace() and (e >= len(at) or z < at[e]):
                z += 1
        x, y = a, z
        while x < y and text[x].isspace():
            x += 1
        while y > x and text[y - 1].isspace():
            y -= 1
        if y > x:
            if e is None and out and not rx["word"].search(text, x, y):
                out[-1] = (out[-1][0], y)  # what is left without a letter belongs to the last sentence
            else:
                out.append((x, y))
        a = z
    return out


COUNTS = ("n", "e", *NEXT)
LEARNED = "lang string, kind string, " + ", ".join(f"{c} long" for c in COUNTS)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task: of marks by language and kind, of Chinese characters, of transitions."""
    counts: dict[tuple[str, str], list[int]] = {}
    rx = _re()

    def of(lang: str, kind: str) -> list[int]:
        return counts.setdefault((lang, kind), [0] * len(COUNTS))

    def rows() -> pa.RecordBatch:
        keys, vals = list(counts), list(counts.values())
        out = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([v[i] for v in vals], pa.int64()) for i in range(len(COUNTS))]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, names=["lang", "kind", *COUNTS])

    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text:
                continue
            s, _ = simplify(text)
            lang = language_of(s, label)
            seen: set[str] = set()
            found = marks(s, lang)
            for _, kind, token, nxt in reversed(found):
                if nxt in ("joined", "punct") or kind == "dots" and nxt not in ("upper", "end"):
                    continue
                k = "<ref>" if kind in ("mark", "danda", "shad") else kind_key(kind, token)
                if k[0] != "<":
                    if k in seen:  # a text that repeats a sentence tells no more of its last word
                        continue
                    seen.add(k)
                c = of(lang, k)
                c[0] += 1
                if nxt == "end":
                    c[1] += 1
                elif kind not in ("danda", "shad"):  # after these no script has capitals to tell by
                    c[2 + NEXT.index(nxt)] += 1
            known = KNOWN.get(lang, ())
            last = ""
            for _, kind, token, nxt in found:
                if kind in ("stop", "mark", "danda", "shad") and nxt not in ("joined", "punct"):
                    now = "i" if kind == "stop" and kind_key(kind, token) in known else "b"
                    if last:
                        of(lang, f"<after:{last}{now}>")[0] += 1
                    last = now
            if lang == "zh" and rx["cjkmark"].search(s):
                for part in rx["cjkmark"].split(s):
                    part = "".join(rx["strip"].sub("", part).split())
                    if part:
                        of("char", part[-1])[1] += 1
                        for c in part[:-1]:
                            of("char", c)[0] += 1
                        of("step", "ib" if len(part) > 1 else "bb")[0] += 1
                        of("step", "bi")[0] += len(part) > 1
                        of("step", "ii")[0] += max(0, len(part) - 2)
        if len(counts) > FLUSH:
            yield rows()
    yield rows()


def learn(df: DataFrame, text: str, language: str) -> Emissions:
    """Emissions from all texts. What comes to the driver: pooled classes, characters, and the tokens that end texts less than other words."""
    c = df.select(text, language).mapInArrow(_learn, LEARNED).groupBy("lang", "kind").agg(*[F.sum(x).alias(x) for x in COUNTS])
    known = ",".join(f"'{w}'" for w in sorted({w for ws in KNOWN.values() for w in ws}))
    rare = c.filter(f"lang in ('char', 'step') or kind like '<%' or (n >= 15 and e < 0.1 * n) or kind in ({known})")
    rows = [tuple(r) for r in rare.select("lang", "kind", *COUNTS).toLocalIterator()]
    chars, steps = {r[1]: (r[3], r[2]) for r in rows if r[0] == "char"}, {r[1]: r[2] for r in rows if r[0] == "step"}
    return Emissions([r for r in rows if r[0] not in ("char", "step")], chars, steps)


def split_sentences(df: DataFrame, text: str = "raw_text", language: str = "language", key: str = "id") -> DataFrame:
    """(key, start_char, end_char): one row a sentence."""
    em = df.sparkSession.sparkContext.broadcast(learn(df, text, language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = em.value
        for b in batches:
            ids, at, x, y = b.column(0), [], [], []
            for i, (t, g) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for p, q in sentences(t, g, m):
                    at.append(i)
                    x.append(p)
                    y.append(q)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=[key, "start_char", "end_char"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text, language).filter(F.length(text) > 0).mapInArrow(run, f"`{key}` {kind}, start_char long, end_char long")
