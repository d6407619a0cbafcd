"""Problem 1: one consistent form for text that looks the same but differs in its characters.

Method: a quick check (character classes that cannot occur in canonical text) isolates unstable
segments; only these are normalised, with their neighbours as context, and the canonical segments are
spliced into the text that stays as it is. Each splice is kept as an edit (start, end, replacement), so
offsets into the stored text can be carried over to the canonical text and back.

What is treated as looking the same: canonical composition (NFC, with singletons such as the Kelvin sign
and compatibility ideographs), full-width and half-width forms, invisible format characters, the wide
family of spaces, non-breaking hyphens, Latin ligatures, Arabic presentation forms, and letters of another
script inside a word whose own script is settled by letters that have no look-alike.
What is left alone: characters that a reader tells apart (superscripts, fractions, the numero sign, dashes,
Greek alpha or beta in a gene name), and what a script requires (joiners of emoji, non-joiners between
Arabic-script letters, full-width punctuation beside ideographs or kana, Persian yeh in a Persian word).

Nulls give null, the empty string gives itself; texts of any length are handled whole.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import lru_cache, wraps

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: character classes ---------------------------------------------------------------
# Code points in hexadecimal, single or as first-last.
def _ranges(spec: str) -> list[tuple[int, int]]:
    return [(int(x.split("-")[0], 16), int(x.split("-")[-1], 16)) for x in spec.split()]


INVISIBLE = "AD 61C 180E 200B 200E-200F 202A-202E 2060-2064 2066-206F FEFF"
JOINERS = "200C-200D"
SPACES = "A0 1680 2000-200A 202F 205F 3000"
HYPHENS = "2010-2011"
COMPATIBLE = "FB00-FB06 FB50-FDFF FE70-FEFC FF01-FFEE"
LATIN = "41-5A 61-7A C0-D6 D8-F6 F8-24F"
GREEK = "370-373 375-37D 37F-386 388-3FF"
CYRILLIC = "400-4FF"
ARABIC = "620-64A 66E-6D3 6FA-6FC"
CJK = "2E80-2FDF 3001-30FF 3400-4DBF 4E00-9FFF F900-FAFF 20000-2FA1F"
ZWNJ = chr(0x200C)


def _spec(points: set[int]) -> str:
    """Code points as ranges."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return " ".join(f"{a:X}" if a == b else f"{a:X}-{b:X}" for a, b in out)


def _quick_check_fails() -> set[int]:
    """Code points whose composition quick check is not Yes, by the Unicode database: those that are not composed by
    themselves, those that a letter before them may take in (the second of a canonical pair, vowels and finals of Hangul), and
    marks, whose order may be another."""
    out: set[int] = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for c in (*range(0x300, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)):
        ch = chr(c)
        if unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch):
            out.add(c)
        pair = unicodedata.decomposition(ch)
        if pair and pair[0] != "<" and " " in pair:
            out.add(int(pair.split()[1], 16))
    return out


# Beyond the basic plane Python's regular expressions try range after range, too: there two wide ones stand for all.
UNSTABLE = " ".join([INVISIBLE, JOINERS, SPACES, HYPHENS, COMPATIBLE, _spec({c for c in _quick_check_fails() if c < 0x10000}), "101FD-1E94A 2F800-2FA1F"])
# For the JVM, whose regular expressions try range after range: few and wide ones that hold all of UNSTABLE (a test says so).
SUSPECT = "A0-AD 300-387 483-487 591-5C7 610-61C 64B-670 6D6-6ED 711-10FF 1161-11C2 135D-1DFF 1F71-2011 202A-2126 212A-212B 2329-232A 2ADC-2DFF 3000 302A-302F 3099-309A A66F-ABED F900-FFEE 101FD-1E94A 2F800-2FA1F"


def cls(spec: str) -> str:
    """The code points as the inside of a character class of Python's re."""
    return "".join(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else "") for a, b in _ranges(spec))


def java_cls(spec: str) -> str:
    """The same as a character class of Java's regex."""
    return "[" + "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in _ranges(spec)) + "]"


# Letters of one script that look like letters of another (fixed pairs, in alphabetical order).
CYRILLIC_TO_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХаеіјорсухѕԁһԛԝ", "ABESIJKMHOPCTYXaeijopcyxsdhqw"))
GREEK_TO_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", "ABEZHIKMNOPTYXov"))
LATIN_TO_CYRILLIC = {v: k for k, v in CYRILLIC_TO_LATIN.items() if k not in "ԁһԛԝ"} | {"ë": "ё", "Ë": "Ё", "ï": "ї", "Ï": "Ї"}
LATIN_TO_GREEK = {v: k for k, v in GREEK_TO_LATIN.items()}
GREEK_TO_CYRILLIC = {g: LATIN_TO_CYRILLIC[x] for g, x in GREEK_TO_LATIN.items() if x in LATIN_TO_CYRILLIC}
CYRILLIC_TO_GREEK = {c: LATIN_TO_GREEK[x] for c, x in CYRILLIC_TO_LATIN.items() if x in LATIN_TO_GREEK}
FOLD_TO = {
    "L": CYRILLIC_TO_LATIN | GREEK_TO_LATIN | {"\u0251": "a", "\u0261": "g", "\u0585": "o"},
    "C": LATIN_TO_CYRILLIC | GREEK_TO_CYRILLIC,
    "G": LATIN_TO_GREEK | CYRILLIC_TO_GREEK,
}
# Letters that the tables fold and that lie outside the ranges of Latin, Greek and Cyrillic.
_PLAIN_RANGES = re.compile(f"[{cls(LATIN)}{cls(GREEK)}{cls(CYRILLIC)}]")
FURTHER = " ".join(f"{ord(c):X}" for c in sorted({c for fold in FOLD_TO.values() for c in fold}) if not _PLAIN_RANGES.match(c))
# Cyrillic letters of no use in words of the common Cyrillic orthographies: beside nothing else they speak for Latin.
RARE_CYRILLIC = "ЅЈѕј"
PERSIAN_ONLY = "پچژگ"
# ----------------------------------------------------------------------------------------------------

_UNSTABLE = re.compile(f"[{cls(UNSTABLE)}]")
_INVISIBLE = re.compile(f"[{cls(INVISIBLE)}]")
_UNSEEN = re.compile(f"[ {cls(INVISIBLE)}{cls(JOINERS)}]")
_SPACE = re.compile(f"[{cls(SPACES)}]")
_HYPHEN = re.compile(f"[{cls(HYPHENS)}]")
_TWO_SCRIPTS = re.compile(f"[{cls(GREEK)}{cls(CYRILLIC)}{cls(FURTHER)}]")
_FURTHER = re.compile(f"[{cls(FURTHER)}]")
_LATIN = re.compile(f"[{cls(LATIN)}{cls('FF21-FF3A FF41-FF5A')}]")
_TOKEN = re.compile(r"\S+")
_ARABIC_WORD = re.compile(f"[{cls(ARABIC)}{ZWNJ}]+")
_ARABIC = re.compile(f"[{cls(ARABIC)}]")
_LETTERS = re.compile(f"[{cls(LATIN)}{cls(GREEK)}{cls(CYRILLIC)}{cls(FURTHER)}]+")
_CJK = re.compile(f"[{cls(CJK)}{cls('FF01 FF08-FF09 FF0C FF1A-FF1B FF1F')}]")
# A zone runs from the starter before an unstable character to the last mark behind it.
_ZONE = re.compile(f"[^\\s{cls(UNSTABLE)}]?[{cls(UNSTABLE)}]+")


def quick_check(col: Column) -> Column:
    """True where a text may hold something to normalise. Runs inside the JVM; linear in the text."""
    return F.coalesce(
        col.rlike(java_cls(SUSPECT))
        | (col.rlike(java_cls(f"{GREEK} {CYRILLIC} {FURTHER}")) & col.rlike(java_cls(LATIN + " 405 408 455 458")))
        | col.rlike("\\x{6cc}" + java_cls(ARABIC)),
        F.lit(False),
    )


def _keeps_joiner(text: str, i: int, ch: str) -> bool:
    before = text[i - 1] if i else ""
    after = text[i + 1] if i + 1 < len(text) else ""
    if not before or not after:
        return False
    if unicodedata.combining(before) == 9:  # after a virama
        return True
    if ch == ZWNJ:
        return bool(_ARABIC.match(before) and _ARABIC.match(after))
    return (ord(before) >= 0x1F000 or 0x2600 <= ord(before) <= 0x27BF or ord(before) == 0xFE0F) and (ord(after) >= 0x1F000 or 0x2600 <= ord(after) <= 0x27BF)


def _beside_cjk(text: str, i: int) -> bool:
    for step in (-1, 1):
        j = i + step
        while 0 <= j < len(text) and _UNSEEN.match(text[j]):
            j += step
        if 0 <= j < len(text) and _CJK.match(text[j]):
            return True
    return False


def _stable(text: str, start: int, end: int) -> str:
    """Canonical form of text[start:end], a zone; the characters around it give the context."""
    out = []
    for i in range(start, end):
        ch = text[i]
        c = ord(ch)
        if ch == ZWNJ or c == 0x200D:
            if _keeps_joiner(text, i, ch):
                out.append(ch)
        elif _INVISIBLE.match(ch):
            continue
        elif _SPACE.match(ch):
            out.append(" ")
        elif _HYPHEN.match(ch):
            out.append("-")
        elif 0xFF01 <= c <= 0xFF5E:
            plain = chr(c - 0xFEE0)
            out.append(plain if plain.isalnum() or not _beside_cjk(text, i) else ch)
        elif 0xFB00 <= c <= 0xFB06 or 0xFB50 <= c <= 0xFDFF or 0xFE70 <= c <= 0xFEFC or 0xFF65 <= c <= 0xFFEE:
            out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    return unicodedata.normalize("NFC", "".join(out))


def remembered(size: int, longest: int = 64) -> Callable:
    """What a function of a word says, kept for the last `size` words of at most `longest` characters."""

    def wrap(f: Callable) -> Callable:
        kept = lru_cache(size)(f)

        @wraps(f)
        def call(word: str):
            return kept(word) if len(word) <= longest else f(word)

        return call

    return wrap


@remembered(100_000)
def _anchors(word: str) -> frozenset[str]:
    """Scripts of the letters that have no look-alike elsewhere."""
    out = set()
    for ch in word:
        c = ord(ch)
        if c < 0x250:
            if ch.isalpha() and ch not in LATIN_TO_CYRILLIC and ch not in LATIN_TO_GREEK:
                out.add("L")
        elif 0x370 <= c <= 0x3FF:
            if ch not in GREEK_TO_LATIN and ch not in "αβγδμΔΩπσλ":
                out.add("G")
        elif 0x400 <= c <= 0x4FF and ch not in CYRILLIC_TO_LATIN:
            out.add("C")
    return frozenset(out)


@remembered(100_000)
def _scripts(word: str) -> frozenset[str]:
    return frozenset("L" if ord(c) < 0x250 else "G" if ord(c) < 0x400 else "C" for c in word if c.isalpha())


class _Neighbours:
    """The script of the nearest word on either side of a place that tells its script; read once a text, when first asked for."""

    def __init__(self, text: str):
        self.text, self.known = text, False

    def _read(self) -> None:
        if not self.known:
            self.known, self.starts, self.ends, self.scripts = True, [], [], []
            for m in _LETTERS.finditer(self.text):
                a = _anchors(m.group())
                if a:
                    self.starts.append(m.start())
                    self.ends.append(m.end())
                    self.scripts.append(next(iter(a)) if len(a) == 1 else None)

    def before(self, at: int) -> str | None:
        self._read()
        k = bisect_right(self.ends, at) - 1
        return self.scripts[k] if k >= 0 else None

    def after(self, at: int) -> str | None:
        self._read()
        k = bisect_left(self.starts, at)
        return self.scripts[k] if k < len(self.scripts) else None


def _own_script(word: str, token: str, near: _Neighbours, start: int, end: int) -> str | None:
    found = _anchors(word)
    if len(found) == 1:
        return next(iter(found))
    if found:
        return None
    scripts = _scripts(word)
    found = _anchors(token)
    if len(found) == 1:
        return next(iter(found))
    if len(found) > 1:
        return None
    # No letter of the token settles it: the words before and behind must agree.
    around = [s for s in (near.before(start), near.after(end)) if s]
    if around and len(set(around)) == 1 and (len(scripts) > 1 or len(around) == 2 and len(word) > 1 or len(word) > 2 or word.isupper()):
        if len(scripts) > 1 or around[0] == "L":
            return around[0]
    if any(c in RARE_CYRILLIC for c in word):
        return "L"
    if len(scripts) > 1:  # only look-alikes, of two scripts
        count = {s: sum(1 for c in word if _scripts(c) == {s}) for s in scripts}
        return max(count, key=lambda s: (count[s], s == "L"))
    return None


def _persian(word: str) -> bool:
    return ZWNJ in word or any(c in PERSIAN_ONLY for c in word)


@remembered(200_000)
def _doubtful(token: str) -> tuple[tuple[int, str], ...]:
    """(place, word) of the words of a token whose script is to be judged: the same wherever the token stands."""
    if token.isascii() or not _TWO_SCRIPTS.search(token):
        return ()
    out = []
    for w in _LETTERS.finditer(token):
        word = w.group()
        # Letters of other alphabets beside it (Armenian, phonetic script): there these letters are no look-alikes.
        if _FURTHER.search(word) and (token[w.start() - 1 : w.start()].isalpha() or token[w.end() : w.end() + 1].isalpha()):
            continue
        if len(_scripts(word)) < 2 and (_anchors(word) or len(word) < 2 and not _LATIN.search(token) and not (word.isupper() and "." in token)):
            continue
        out.append((w.start(), word))
    return tuple(out)


def _edits_of_look_alikes(text: str) -> list[tuple[int, int, str]]:
    out, near = [], _Neighbours(text)
    if _TWO_SCRIPTS.search(text) and (_LATIN.search(text) or any(c in RARE_CYRILLIC for c in text)):
        for m in _TOKEN.finditer(text):
            token = m.group()
            for at, word in _doubtful(token):
                own = _own_script(word, token, near, m.start(), m.end())
                if own:
                    fold = FOLD_TO[own]
                    out += [(m.start() + at + k, m.start() + at + k + 1, fold[c]) for k, c in enumerate(word) if c in fold]
    yeh = chr(0x6CC)
    if yeh in text:
        words = list(_ARABIC_WORD.finditer(text))
        for k, m in enumerate(words):
            w = m.group()
            if yeh not in w[:-1]:
                continue
            if not any(_persian(x.group()) for x in words[max(0, k - 1) : k + 2]):
                out += [(m.start() + i, m.start() + i + 1, chr(0x64A)) for i, c in enumerate(w[:-1]) if c == yeh and _ARABIC.match(w[i + 1])]
    return out


def canonical_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that make the text canonical: (start, end, replacement) over code points, in order, apart."""
    if text.isascii():
        return []
    first = []
    if _UNSTABLE.search(text):
        for m in _ZONE.finditer(text):
            start, end = m.span()
            new = _stable(text, start, end)
            old = text[start:end]
            if new != old:
                while start < end and new and old[0] == new[0] and (len(old) < 2 or not unicodedata.combining(old[1])):
                    start, old, new = start + 1, old[1:], new[1:]
                first.append((start, end, new))
    # Letters of another script are judged in words that are already whole.
    middle = apply_edits(text, first)
    second = _edits_of_look_alikes(middle)
    if not second:
        return first
    return _compose(first, second)


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    if not edits:
        return text
    out, at = [], 0
    for s, e, r in edits:
        out += [text[at:s], r]
        at = e
    return "".join([*out, text[at:]])


def _compose(first: list[tuple[int, int, str]], second: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """One list of edits over the source for edits of the source and edits (single letters) of their result."""
    spans, shifts = [], [0]  # where each first edit lies in the middle text, and how far all before it move what follows
    for s, e, r in first:
        spans.append((s + shifts[-1], s + shifts[-1] + len(r)))
        shifts.append(shifts[-1] + len(r) - (e - s))
    starts = [a for a, _ in spans]
    changed: dict[int, list[str]] = {}
    out = []
    for s, _, r in second:
        n = bisect_right(starts, s)
        k = n - 1
        while k >= 0 and spans[k][0] == spans[k][1] == s:
            k -= 1
        if k >= 0 and spans[k][0] <= s < spans[k][1]:
            changed.setdefault(k, list(first[k][2]))[s - spans[k][0]] = r
        else:
            out.append((s - shifts[n], s - shifts[n] + 1, r))
    out += [(s, e, "".join(changed[k]) if k in changed else r) for k, (s, e, r) in enumerate(first)]
    return sorted(out)


def canonicalize(text: str | None) -> str | None:
    return text if text is None else apply_edits(text, canonical_edits(text))


def to_canonical_offset(edits: list[tuple[int, int, str]], offset: int, end: bool = False) -> int:
    """Where an offset of the source lies in the canonical text. Inside an edit it moves to the edit's start,
    as an end offset to its end."""
    shift = 0
    for s, e, r in edits:
        if e <= offset:
            shift += len(r) - (e - s)
        elif s < offset:
            return s + shift + (len(r) if end else 0)
        else:
            break
    return offset + shift


# s, e, r: an edit; d: how far all edits before it move what follows.
EDIT = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("r", T.StringType()), T.StructField("d", T.IntegerType())])


@F.pandas_udf(T.StringType())
def canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonicalize)


def _with_shifts(text: str | None) -> list[tuple[int, int, str, int]]:
    out, d = [], 0
    for s, e, r in canonical_edits(text) if text else []:
        out.append((s, e, r, d))
        d += len(r) - (e - s)
    return out


@F.pandas_udf(T.ArrayType(EDIT))
def edits_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_with_shifts)


def canonical_column(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds `to`, the canonical form of `column`. Only texts that fail the quick check reach Python; the others are sent as
    nulls, so the input is read once."""
    suspect = quick_check(F.col(column))
    return df.withColumn(to, F.when(suspect, canonical_udf(F.when(suspect, F.col(column)))).otherwise(F.col(column)))


def documents_with_edits(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edits): texts that need edits only; the unstable segments with their canonical form."""
    d = documents.select(F.col(id_col), F.col(text_col).alias("__text")).where(quick_check(F.col("__text")))
    d = d.withColumn("edits", edits_udf(F.col("__text")))
    return d.where(F.size("edits") > 0).select(id_col, F.col("__text").alias(text_col), "edits")


def _splice(text: Column, edits: Column) -> Column:
    """The text with its edits applied, inside the JVM."""
    pieces = F.transform(
        edits,
        lambda x, i: F.concat(
            F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.element_at(edits, F.greatest(i, F.lit(1)))["e"] + 1), x["s"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at(edits, F.greatest(i, F.lit(1)))["e"])),
            x["r"],
        ),
    )
    return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(edits, -1)["e"] + 1, F.length(text)))


def _edits_before(edits: Column, offset: Column) -> Column:
    """How many edits begin before an offset, by bisection: the steps follow the logarithm of their number."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(edits) + F.lit(1))).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(edits).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        ended, less = at["lo"] >= at["hi"], F.get(edits, middle)["s"] < offset
        return F.struct(F.when(~ended & less, middle + 1).otherwise(at["lo"]).alias("lo"), F.when(ended | less, at["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(steps, start, halve, lambda at: at["lo"])


def _moved(offset: Column, edits: Column, end: bool) -> Column:
    """`to_canonical_offset` inside the JVM."""

    def move(x: Column) -> Column:  # x: the last edit that begins before the offset, or null
        inside = x["s"] + x["d"] + (F.length(x["r"]) if end else F.lit(0))
        return F.when(x.isNull(), offset).when(x["e"] > offset, inside).otherwise(offset + x["d"] + F.length(x["r"]) - (x["e"] - x["s"]))

    return F.get(F.transform(F.array(F.get(edits, _edits_before(edits, offset) - 1)), move), F.lit(0))


def canonical_documents(documents: DataFrame) -> DataFrame:
    """Every document with its canonical text and the number of spliced segments."""
    suspect = quick_check(F.col("text"))
    d = documents.select("doc_id", "text", edits_udf(F.when(suspect, F.col("text"))).alias("edits"))
    return d.select("doc_id", F.when(F.size("edits") > 0, _splice(F.col("text"), F.col("edits"))).otherwise(F.col("text")).alias("canonical_text"), F.size("edits").alias("n_edits"))


def _with_stretch(predictions: DataFrame, documents: DataFrame) -> DataFrame:
    """Predictions with the edits and the stretch of their document, where it has any edits to make.

    Documents are reduced to those that fail the quick check before they are shuffled. A document with very
    many entities is one hot join key: the sort-merge join is split by adaptive execution."""
    p = predictions.select("pred_id", "doc_id", "text", "start_char", "end_char")
    d = documents_with_edits(documents).select(F.col("doc_id"), F.col("text").alias("__doc"), "edits")
    whole = (F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char"))
    return p.join(d, "doc_id", "left").withColumn("stretch", F.when(whole, F.expr("substring(__doc, start_char + 1, end_char - start_char)")))


def canonical_entities(predictions: DataFrame, documents: DataFrame) -> DataFrame:
    """(pred_id, doc_id, canonical_text, canonical_start, canonical_end, changed): one row per prediction.

    Offsets fit the canonical document. Null texts or offsets stay null; a stretch outside the document is
    as empty as `substring` makes it."""
    j = _with_stretch(predictions, documents)
    e = F.col("edits")
    j = j.withColumn("canonical_start", F.when(e.isNull(), F.col("start_char")).otherwise(_moved(F.col("start_char"), e, False)))
    j = j.withColumn("canonical_end", F.when(e.isNull(), F.col("end_char")).otherwise(_moved(F.col("end_char"), e, True)))
    j = canonical_column(j.drop("__doc", "edits"), "text", "canonical_text")
    return j.select("pred_id", "doc_id", "canonical_text", "canonical_start", "canonical_end")


def entities_to_mend(predictions: DataFrame, documents: DataFrame) -> DataFrame:
    """(pred_id): rows whose text, or whose stretch of the document, is not in canonical form.

    The stretch counts by itself: an edit of the document that lies in it makes the case, so that context
    outside the stretch (a neighbouring word) can settle a script but not add a case."""
    p = predictions.select("pred_id", "doc_id", "text", "start_char", "end_char")
    own = p.where(quick_check(F.col("text"))).select("pred_id", "text").withColumn("c", canonical_udf(F.col("text")))
    own = own.where(F.col("c") != F.col("text")).select("pred_id")
    segments = (
        documents.select("doc_id", F.col("text").alias("__text"))
        .where(quick_check(F.col("__text")))
        .select("doc_id", edits_udf(F.col("__text")).alias("edits"))
        .where(F.size("edits") > 0)
    )
    spans = p.where((F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char"))).select("pred_id", "doc_id", "start_char", "end_char")
    last = F.get(F.col("edits"), _edits_before(F.col("edits"), F.col("end_char")) - 1)  # edits lie apart: the last that begins in time decides
    touched = spans.join(segments, "doc_id").where(last["e"] > F.col("start_char")).select("pred_id")
    return own.unionByName(touched).distinct()
