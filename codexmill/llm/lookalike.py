"""One form for texts that look the same.

A text is brought to a canonical form in two steps. The first is free of context:
invisible characters go, spaces of every kind become a blank, hyphens of every
kind a hyphen, width variants and compatibility ideographs their plain
characters, and accents are composed in canonical order. Raised, lowered and
circled signs stay, as a reader sees them. The second is script-aware repair of
letters: each token gets its dominant script - that of most of its letters that
have no double elsewhere, else that of most such letters of the text. A token that is
not spelled in that script as far as its letters have doubles there is mixed; its
letters are substituted when the whole token then stands in the vocabulary of the
corpus: the tokens that are not mixed.

Two records show the same if their repaired texts are equal. A mixed token that the
vocabulary cannot settle is compared by what is drawn (every double in its Latin
form). The dominant script follows from letters without doubles only, so
tokens that look the same are repaired alike, and where one of them is spelled well in
some record, the others are settled by it: no pair is lost, and none is won by it.

Defined results: null stays null; empty stays empty; a text of invisible
characters only becomes empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.session import spool

#: Tasks over which the records of one class are spread.
SALT = 8
#: Letters of other scripts and the Latin letters they are drawn like.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y",
    "Х": "X", "Һ": "H", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y",
    "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ϳ": "j", "ϲ": "c",
}
OTHER_LATIN = {"ɡ": "g", "ɑ": "a"}
ARMENIAN = {"ո": "n", "ս": "u", "օ": "o", "Ս": "U", "Օ": "O", "հ": "h"}
DOUBLES = CYRILLIC | GREEK | OTHER_LATIN | ARMENIAN


def _accented() -> dict[str, str]:
    """Composed letters whose base has a double: the same accents on the double."""
    import unicodedata as u

    out = {}
    for cp in [*range(0x370, 0x590), *range(0x1F00, 0x2000)]:
        d = u.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0] in DOUBLES:
            out[chr(cp)] = u.normalize("NFC", DOUBLES[d[0]] + d[1:])
    return out


DOUBLES |= _accented()
#: The letters that do not tell a script.
UNSURE = DOUBLES.keys() | set(DOUBLES.values())
#: Signs drawn alike.
SIGNS = {
    "‐": "-", "‑": "-", "﹣": "-", "−": "-", "༌": "་", ";": ";", "·": "·", "`": "`", "․": ".",
    "∣": "|", "ǀ": "|", "ǃ": "!", "׃": ":", "∶": ":", "꞉": ":", "⁄": "/", "∕": "/", "ʼ": "’", "ʻ": "‘",
}
#: Compatibility mappings of these kinds change what a reader sees.
SEEN_KINDS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")


def _char_map() -> dict[int, str | None]:
    """Every character whose plain form differs: built from the Unicode tables."""
    import sys
    import unicodedata as u

    out: dict[int, str | None] = {}
    for cp in range(128, sys.maxunicode + 1):
        c = chr(cp)
        cat = u.category(c)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if cat == "Zs":
            out[cp] = " "
        elif cat == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5):
            out[cp] = None
        else:
            kind = u.decomposition(c)
            if not kind:
                continue
            if kind.startswith("<"):
                if kind.startswith(SEEN_KINDS) or cat == "No" or c in DOUBLES:
                    continue
                if kind.startswith("<compat>") and cat not in ("Lo", "Lu", "Ll", "Nl", "So") and cp != 0x2024:
                    if cp != 0x2026:  # an ellipsis stays one sign
                        out[cp] = u.normalize("NFKC", c)
                elif kind.startswith("<compat>") and cat == "So" and not 0x2E80 <= cp <= 0x2FDF:
                    continue
                else:
                    out[cp] = u.normalize("NFKC", c)
            elif u.normalize("NFC", c) != c:
                out[cp] = u.normalize("NFC", c)
    out.update({ord(k): v for k, v in SIGNS.items()})
    out[0x9] = out[0xB] = out[0xC] = out[0x85] = " "
    return out


_MAP: dict[int, str | None] | None = None


def plain(text: str) -> str:
    """First step: everything that needs no context."""
    import unicodedata as u

    global _MAP
    if text.isascii() and "\t" not in text and "\x0b" not in text and "\x0c" not in text:
        return text
    if _MAP is None:
        _MAP = _char_map()
    hit = {ord(c) for c in set(text)} & _MAP.keys()
    if hit:
        text = text.translate({c: _MAP[c] for c in hit})
    return text if u.is_normalized("NFC", text) else u.normalize("NFC", text)


def _script(c: str) -> str:
    if "Ѐ" <= c <= "ԯ":
        return "Cyrillic"
    if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
        return "Greek"
    if "԰" <= c <= "֏":
        return "Armenian"
    if c <= "ɏ" or "Ḁ" <= c <= "ỿ":
        return "Latin"
    return "other"


def _back(letters: dict[str, str], first: str, last: str) -> dict[str, str]:
    """Latin letters to their doubles in one script, plain or with accents."""
    return {v: k for k, v in DOUBLES.items() if first <= k <= last and k not in "Һһ"} | {v: k for k, v in letters.items() if k not in "Һһ"}


#: The doubles of each script, from the Latin form.
BACK = {"Cyrillic": _back(CYRILLIC, "Ѐ", "ԯ"), "Greek": _back(GREEK, "Ͱ", "῿"), "Armenian": _back(ARMENIAN, "԰", "֏")}

_PATTERNS: list = []


def _patterns():
    import regex

    if not _PATTERNS:
        _PATTERNS.extend((regex.compile(r"[\p{L}\p{M}\p{N}]+"), regex.compile("[Ͱ-֏ἀ-῿" + "".join(OTHER_LATIN) + "]")))
    return _PATTERNS


def text_script(text: str, otherwise: str = "Latin") -> str:
    """Script of most letters that tell one."""
    from collections import Counter

    n = Counter()
    for c, k in Counter(text).items():
        if c.isalpha() and c not in UNSURE:
            n[_script(c)] += k
    return max(n, key=lambda s: (n[s], s)) if n else otherwise


def fold(text: str) -> str:
    """Every double in its Latin form: what is drawn, not what is meant."""
    import unicodedata as u

    if text.isascii():
        return text
    hit = {c for c in set(text) if c in DOUBLES}
    return u.normalize("NFC", text.translate({ord(c): DOUBLES[c] for c in hit})) if hit else text


def repaired(token: str, of_text: str) -> str:
    """The token with the letters of its dominant script wherever that script draws one alike."""
    import unicodedata as u

    back = BACK.get(text_script(token, of_text))
    t = fold(token)
    return u.normalize("NFC", "".join(back.get(c, c) for c in t)) if back else t


def candidates(text: str) -> list[tuple[str, str]]:
    """(token, repaired token) for the mixed tokens of a text in plain form."""
    find, foreign = _patterns()
    if text.isascii() or not foreign.search(text):
        return []
    own = text_script(text)
    out = {}
    for t in find.findall(text):
        if t not in out and (own in BACK or foreign.search(t)):
            out[t] = repaired(t, own)
    return [(t, r) for t, r in out.items() if r != t]


def substitute(text: str, good: dict[str, str]) -> str:
    find, _ = _patterns()
    return find.sub(lambda m: good.get(m[0], m[0]), text)


def with_plain(df: DataFrame, text: str) -> DataFrame:
    """df with ``_plain`` and ``_cand`` (array of token and repaired token) in place of the text."""
    names = [c for c in df.columns if c != text]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = [None if t is None else plain(t) for t in b[text]]
            yield b[names].assign(_plain=p, _cand=[[] if t is None else [{"token": x, "fixed": y} for x, y in candidates(t)] for t in p])

    return df.mapInPandas(run, f"{fields}_plain string, _cand array<struct<token:string,fixed:string>>")


def vocabulary_hits(plain_texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (column fixed) that stand, not mixed, as a token of some text.

    plain_texts: ``_plain`` and ``_cand`` (``with_plain``).
    """
    toks = F.array_distinct(F.regexp_extract_all("_plain", F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1)))
    toks = plain_texts.select(F.explode(F.array_except(toks, F.col("_cand.token"))).alias("fixed")).distinct()
    return wanted.join(toks, "fixed", "left_semi")


def unify(df: DataFrame, text: str, key: str = "id", **more: Column) -> DataFrame:
    """(key, unified, look, more...): the texts in their canonical form, and what they are compared by.

    ``look`` is ``unified`` with the mixed tokens that the vocabulary cannot settle as they are
    drawn. Both are null where the text is null.
    """
    p = spool(with_plain(df.select(key, F.col(text).alias("_text"), *[c.alias(n) for n, c in more.items()]), "_text"), "plain")
    # Rows are told apart by a number, which must be the same wherever it is read.
    mixed = spool(p.filter(F.size("_cand") > 0).withColumn("_row", F.monotonically_increasing_id()), "mixed")
    cand = mixed.select("_row", F.explode("_cand").alias("c")).select("_row", "c.token", "c.fixed")
    good = vocabulary_hits(p, cand.select("fixed").distinct())
    fixes = cand.join(good, "fixed", "left_semi").groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("token", "fixed"))).alias("_good"))
    done = mixed.join(fixes, "_row", "left")

    @F.pandas_udf("unified string, look string")
    def apply(texts: pd.Series, cand: pd.Series, good: pd.Series) -> pd.DataFrame:
        unified, look = [], []
        for t, c, g in zip(texts, cand, good):
            settled = dict(g) if g is not None and len(g) else {}
            left = {x["token"]: fold(x["token"]) for x in c if x["token"] not in settled}
            unified.append(substitute(t, settled))
            look.append(substitute(t, settled | left))
        return pd.DataFrame({"unified": unified, "look": look}, dtype=object)

    left = p.filter(F.size("_cand") == 0).select(key, F.col("_plain").alias("unified"), F.col("_plain").alias("look"), *more)
    return left.unionByName(done.select(key, apply("_plain", "_cand", "_good").alias("u"), *more).select(key, "u.unified", "u.look", *more))


def _members(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, look, form): the records that look like a record of another text; texts stand as pairs of hashes."""
    rows = unify(df, text, key, form=_pair(text)).filter("look is not null").select(F.col(key).alias("key"), _pair("look").alias("look"), "form")
    ends = [f("form.%s" % c).alias(f.__name__ + c) for c in "ab" for f in (F.min, F.max)]
    several = rows.groupBy("look").agg(*ends).filter("mina <> maxa or minb <> maxb").select("look")
    return spool(rows.join(several, "look", "left_semi"), "looks")


def _pair(text: str) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.reverse(text), F.length(text)).alias("b"))


def look_classes(df: DataFrame, text: str = "raw_text", key: str = "id") -> DataFrame:
    """(key, class_id, n_records, n_forms): each record that looks like one of another text, with its class.

    class_id is the least key of the class; no pairs are formed, however large a class is.
    """
    m = _members(df, text, key)
    c = m.groupBy("look").agg(F.min("key").alias("class_id"), F.count("*").alias("n_records"), F.count_distinct("form").alias("n_forms"))
    return m.join(c, "look").select(F.col("key").alias(key), "class_id", "n_records", "n_forms")


def same_look(df: DataFrame, text: str = "raw_text", key: str = "id") -> DataFrame:
    """(id_a, id_b): pairs whose texts differ in characters and look the same.

    The result is defined by pairs of records, so classes (``look_classes``) are spelled out: the different
    texts of a class are paired, then their records, salted so that a large class is several tasks'.
    """
    m = _members(df, text, key)
    forms = m.select("look", "form").distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(SALT)).cast("int").alias("salt")
    a = forms.select("look", F.col("form").alias("form_a"), own("form"))
    b = forms.select("look", F.col("form").alias("form_b"), salts)
    pairs = a.join(b, ["look", "salt"]).filter("form_a < form_b").select("look", "form_a", "form_b")
    left = m.select("look", F.col("form").alias("form_a"), F.col("key").alias("x"), own("key"))
    right = m.select("look", F.col("form").alias("form_b"), F.col("key").alias("y"))
    both = pairs.select("*", salts).join(left, ["look", "form_a", "salt"]).join(right, ["look", "form_b"])
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def unify_all(df: DataFrame, fields: tuple[str, ...] = ("raw_text", "norm_text", "folded_text"), key: str = "id") -> DataFrame:
    """(key, field, unified): each text field in its canonical form.

    Every field is unified with the vocabulary of its own column.
    """
    out = None
    for f in fields:
        u = unify(df, f, key).select(key, F.lit(f).alias("field"), "unified")
        out = u if out is None else out.unionByName(u)
    return out
