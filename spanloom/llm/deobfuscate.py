"""Transducers that turn disguises of identifiers into plain characters, with a map back to the source.

Each transducer reads a text and gives edits (start, end, replacement): `at` and `dot` in words or brackets become @ and .,
letters set apart before and behind an @ close up, spelled digits become digits, digits set apart close up. Texts without
the words or signs that a transducer needs are passed by after a few searches. `Offsets` carries spans of the edited text
back to the text that the edits were made for; maps of several steps are applied one after the other."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from ..operators.claims import Claims
from .canonical_text import apply_edits

Edit = tuple[int, int, str]

# --- fixed values: words for signs and digits, by language ---------------------------------------------
AT_WORDS = "at ät arroba arobase chiocciola apenstaartje klammeraffe".split()
DOT_WORDS = "dot punkt point punto ponto punt".split()
DASH_WORDS = "dash hyphen minus strich bindestrich tiret guion guión trattino hífen streepje дефис тире".split()
DIGITS_BY_LANGUAGE = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "it": "zero uno due tre quattro cinque sei sette otto nove",
    "pt": "zero um dois três quatro cinco seis sete oito nove",
    "nl": "nul een twee drie vier vijf zes zeven acht negen",
    "ru": "ноль один два три четыре пять шесть семь восемь девять",
    "uk": "нуль один два три чотири п'ять шість сім вісім дев'ять",
    "el": "μηδέν ένα δύο τρία τέσσερα πέντε έξι επτά οκτώ εννέα",
    "ar": "صفر واحد اثنان ثلاثة أربعة خمسة ستة سبعة ثمانية تسعة",
}
FURTHER_DIGITS = {"oh": 0, "zwo": 2, "une": 1, "uma": 1, "duas": 2, "una": 1, "нуль": 0, "εφτά": 7, "οχτώ": 8, "εννιά": 9, "п’ять": 5, "дев’ять": 9, "één": 1}
REPEATED = {"double": 2, "doppel": 2, "doble": 2, "doppio": 2, "duplo": 2, "dubbel": 2, "triple": 3, "triplo": 3}
IDEOGRAPHS = "〇零一二三四五六七八九"
LEAST_WORDS, LEAST_DIGITS, MOST_DIGITS = 3, 7, 15
# -------------------------------------------------------------------------------------------------------

DIGIT_WORDS = {w: str(k) for words in DIGITS_BY_LANGUAGE.values() for k, w in enumerate(words.split())} | {w: str(k) for w, k in FURTHER_DIGITS.items()}
_DIGIT_SET = frozenset(DIGIT_WORDS)


class Offsets:
    """From the text that edits make back to the text that they were made for."""

    def __init__(self, edits: list[Edit]):
        self.edits, self.at, shift = edits, [], 0
        for s, e, r in edits:
            self.at.append(s + shift)
            shift += len(r) - (e - s)

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The source of the characters start..end-1 (at least one)."""
        return self._char(start)[0], self._char(end - 1)[1]

    def _char(self, p: int) -> tuple[int, int]:
        k = bisect_right(self.at, p) - 1
        if k < 0:
            return p, p + 1
        s, e, r = self.edits[k]
        inside = p - self.at[k]
        if inside >= len(r):
            return e + inside - len(r), e + inside - len(r) + 1
        if len(r) > e - s:
            return (s if inside == 0 else e - 1), e
        return s + inside, (e if inside == len(r) - 1 else s + inside + 1)


# --- at and dot -----------------------------------------------------------------------------------------

_WORDS_AT, _WORDS_DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_AT_SIGN = rf"\s?[\[({{<]\s?(?:{_WORDS_AT}|@)\s?[\])}}>]\s?"
_DOT_SIGN = rf"\s?[\[({{<]\s?(?:{_WORDS_DOT}|\.)\s?[\])}}>]\s?"
_DOT_WORD = rf"\s(?:{_WORDS_DOT})\s"
_PART = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?"
_LOCAL = rf"(?<![A-Za-z0-9._%+-]){_PART}(?:(?:{_DOT_SIGN}|{_DOT_WORD}){_PART})*"
_LABEL = r"[A-Za-z0-9-]+"
_DOMAIN = rf"{_LABEL}(?:(?:\.|{_DOT_SIGN}|{_DOT_WORD}){_LABEL})+"
_SPELLED_DOMAIN = rf"{_LABEL}(?:\.{_LABEL})*(?:{_DOT_SIGN}|{_DOT_WORD}){_LABEL}(?:(?:\.|{_DOT_SIGN}|{_DOT_WORD}){_LABEL})*"
# Beside a plain `at` words that are common in English are no dots, and an article is no label.
_ENGLISH = rf"\s(?:at|ät)\s(?!(?:the|an?|this|that|one)\s)(?={_LABEL}(?:\.{_LABEL})*(?:{_DOT_SIGN}|\s(?:dot|punkt|punto|ponto)\s){_LABEL})"
_FOREIGN = rf"\s(?:{'|'.join(AT_WORDS[2:])})\s(?={_SPELLED_DOMAIN})"
_SIGN = re.compile(rf"{_AT_SIGN}|{_ENGLISH}|{_FOREIGN}|\s@\s?|@\s?", re.I)
_LOCAL_BEFORE, _DOMAIN_AFTER = re.compile(rf"{_LOCAL}$", re.I), re.compile(rf"{_DOMAIN}(?![A-Za-z0-9])", re.I)
_ANY_DOT = re.compile(rf"{_DOT_SIGN}|{_DOT_WORD}", re.I)
_APART = re.compile(r"(?<![^\s(<\[])((?:[A-Za-z0-9._+-] ){2,})@( ?[A-Za-z0-9-](?![A-Za-z0-9-])(?: [A-Za-z0-9-](?![A-Za-z0-9-]))*(?: ?\.(?: ?[A-Za-z0-9-](?![A-Za-z0-9-]))+)+| ?[A-Za-z0-9-]{2,}(?:\.[A-Za-z0-9-]+)+)")
_BRACKETED = re.compile(rf"[\[({{<]\s?(?:{_WORDS_AT}|{_WORDS_DOT}|[@.])\s?[\])}}>]", re.I)
_AT_BLANKS, _DOT_BLANKS = [f" {w} " for w in AT_WORDS], [f" {w} " for w in DOT_WORDS]
LONGEST_LOCAL = 254  # characters of an address, its disguise included, before the sign


def address_edits(text: str, low: str) -> list[Edit]:
    """Disguised e-mail addresses made plain. An address wants a part before the sign, and labels joined by dots behind it; the
    word `at` between blanks counts only if one of those dots is spelled, too."""
    bracketed, sign = _BRACKETED.search(text) is not None, "@" in text
    if not (bracketed or sign or any(h in low for h in _AT_BLANKS)):
        return []
    dots = bracketed or any(h in low for h in _DOT_BLANKS)
    if not (dots or " @" in text or "@ " in text):
        return []
    out: list[Edit] = []
    claims = Claims()
    if " @" in text:
        for m in _APART.finditer(text):
            if claims.take(*m.span()):
                out += [(m.start() + k, m.start() + k + 1, "") for k, c in enumerate(m.group()) if c == " "]
    for m in _SIGN.finditer(text):
        domain = _DOMAIN_AFTER.match(text, m.end())
        if not domain or m.group() == "@" and not dots:
            continue
        lo = max(0, m.start() - LONGEST_LOCAL)
        local = _LOCAL_BEFORE.search(text[lo : m.start()])
        if not local or not claims.take(lo + local.start(), domain.end()):
            continue
        out += [(lo + local.start() + x.start(), lo + local.start() + x.end(), ".") for x in _ANY_DOT.finditer(local.group())]
        if m.group() != "@":
            out.append((m.start(), m.end(), "@"))
        out += [(domain.start() + x.start(), domain.start() + x.end(), ".") for x in _ANY_DOT.finditer(domain.group())]
    return sorted(out)


# --- digits ---------------------------------------------------------------------------------------------

_WORD = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
_UNIT = rf"(?:(?:{'|'.join(REPEATED)})\s)?(?:{_WORD})(?!\w)|\d+"
_DASHES = "|".join(DASH_WORDS)
_RUN = re.compile(rf"(?<![\w.,+-])(?:(?:plus|\+)\s?)?(?:{_UNIT})(?:(?:\s(?:{_DASHES}|slash|{_WORDS_DOT})\s|[ ,./-]{{1,3}})(?:{_UNIT}))+(?!\w)", re.I)
_PIECE = re.compile(rf"(?P<times>(?:{'|'.join(REPEATED)})\s)?(?P<word>(?<!\w)(?:{_WORD})(?!\w))|(?P<digits>\d+)|(?P<dash>{_DASHES})|(?P<slash>slash)|(?P<dot>{_WORDS_DOT})|(?P<plus>plus)|(?P<blank>[\s,]+)", re.I)
_IDEOGRAPH_RUN = re.compile(f"[{IDEOGRAPHS}]{{{LEAST_DIGITS},{MOST_DIGITS}}}")
_APART_DIGITS = re.compile(r"\d \d(?: \d){5,}")
_NO_NEIGHBOUR = frozenset("0123456789.,+-")


def _close_words(low: str) -> bool:
    """Whether LEAST_WORDS digit words stand close together."""
    at = [k for k, w in enumerate(low.replace(",", " ").replace("-", " ").split()) if w in _DIGIT_SET]
    return any(b - a <= 3 * LEAST_WORDS for a, b in zip(at, at[LEAST_WORDS - 1 :]))


def digit_edits(text: str, low: str) -> tuple[list[Edit], list[tuple[int, int]]]:
    """Spelled and scattered digits made plain, and where such runs lie in the text.

    A run counts with LEAST_WORDS digit words and LEAST_DIGITS digits or more; a word for a dash stays as a dash, blanks and
    commas between the pieces go."""
    out: list[Edit] = []
    runs: list[tuple[int, int]] = []
    claims = Claims()
    if _close_words(low):
        for m in _RUN.finditer(text):
            edits, n_words, n_digits = [], 0, 0
            for x in _PIECE.finditer(m.group()):
                kind, at = x.lastgroup, (m.start() + x.start(), m.start() + x.end())
                if kind == "word":
                    d = DIGIT_WORDS[x["word"].lower()] * REPEATED.get((x["times"] or "").strip().lower(), 1)
                    edits.append((*at, d))
                    n_words, n_digits = n_words + 1, n_digits + len(d)
                elif kind == "digits":
                    n_digits += len(x.group())
                else:
                    edits.append((*at, {"dash": "-", "slash": "/", "dot": ".", "plus": "+"}.get(kind, "")))
            if n_words >= LEAST_WORDS and LEAST_DIGITS <= n_digits <= MOST_DIGITS and claims.take(*m.span()):
                out += edits
                runs.append(m.span())
    if not text.isascii() and any(c in text for c in IDEOGRAPHS):
        for m in _IDEOGRAPH_RUN.finditer(text):
            if claims.take(*m.span()):
                out += [(m.start() + k, m.start() + k + 1, str(max(0, IDEOGRAPHS.index(c) - 1))) for k, c in enumerate(m.group())]
                runs.append(m.span())
    for m in _APART_DIGITS.finditer(text):
        a, b = m.span()
        alone = text[a - 1 : a] not in _NO_NEIGHBOUR and text[b : b + 1] not in _NO_NEIGHBOUR and not text[max(0, a - 2) : a - 1].isdigit() and not text[b + 1 : b + 2].isdigit()
        if alone and b - a < 2 * MOST_DIGITS and claims.take(a, b):
            out += [(a + k, a + k + 1, "") for k in range(1, b - a, 2)]
    return sorted(out), sorted(runs)


def plain_edits(text: str) -> tuple[list[Edit], list[tuple[int, int]]]:
    """All edits of a canonical text, in order and apart, and the runs of spelled digits in it."""
    low = text.lower()
    digits, runs = digit_edits(text, low)
    signs = address_edits(text, low)
    if digits and signs:  # what one transducer rewrites the other leaves
        claims = Claims()
        for s, e, _ in digits:
            claims.add(s, e)
        signs = [x for x in signs if claims.free(x[0], x[1])]
    return sorted(digits + signs), runs


def moved(edits: list[Edit], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where spans, whose ends lie in no edit, are in the edited text."""
    starts, shifts = [s for s, _, _ in edits], [0]
    for s, e, r in edits:
        shifts.append(shifts[-1] + len(r) - (e - s))
    return [(a + shifts[bisect_left(starts, a)], b + shifts[bisect_left(starts, b)]) for a, b in spans]


__all__ = ["Offsets", "apply_edits", "moved", "plain_edits"]
