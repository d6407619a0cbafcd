"""Problem 8: personal information inside free text, replaced by placeholders of its type.

Method: offset-preserving deobfuscation. Two steps of edits, each with a map back to what it was made for, turn the stored
text into a plain one: the canonical form of problem 1 (look-alike letters, full-width forms, invisible characters), then the
transducers of `deobfuscate` (at/dot disguises, letters and digits set apart, spelled digits of the corpus languages). The
recognisers read only that plain text; their spans go back through both maps to the characters of the stored text.

Recognisers: email addresses, phone numbers, identity numbers and street addresses by their forms, with words
before them that speak against (order, ISBN, version, ...); names of people by given names and surnames of a
catalogue, given names with one typing error, surnames that end like the catalogue's, initials, and the order of
the parts, and by titles before and verbs of people beside capitalised words that no catalogue holds; in scripts without
that catalogue, by capitals (Cyrillic, Greek) or by known parts and the words around.
A name that could be read in two ways is taken at its longest; where recognisers overlap, email goes before
identity, phone, address and name. A run of spelled digits that has no other form is a phone number.

Null and empty texts have no occurrences. Every text is read whole, in time linear in its length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.claims import Claims
from .canonical_text import apply_edits, canonical_edits, remembered
from .deobfuscate import Offsets, moved, plain_edits
from .name_lexicon import ALSO_WORDS, ARABIC_GIVEN, CHINESE_SURNAMES, NICKNAMES, TITLES

Span = tuple[str, int, int]

# --- forms ----------------------------------------------------------------------------------------

_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+%-])?$")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?![A-Za-z0-9])")

_B = r"(?<![A-Za-z0-9.+/#-])(?<![0-9] )"
_E = r"(?![A-Za-z0-9]|[.,/-]\d)"
IDENTITY = re.compile(
    "|".join(
        f"{_B}{p}{_E}"
        for p in (
            r"[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]",  # social insurance, letters at both ends
            r"[A-Za-z]{2}\d{7}", r"[A-Za-z]\d{8}",  # passports, identity cards
            r"\d{8}-?[A-Za-z]", r"[XYZxyz]-?\d{7}-?[A-Za-z]",
            r"\d{3}\.\d{3}\.\d{3}-\d{2}",
            r"[12] \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}", r"[12]\d{14}",
            r"\d{2} \d{3} \d{3} \d{3}",
            r"\d{3}-\d{2}-\d{4}", r"\d{3} \d{2} \d{4}",
        )
    )
)
PHONE = re.compile(
    "|".join(
        f"{b}{p}{_E}"
        for b, p in (
            (r"(?<![\w+])", r"\+\d{1,3}(?:\s?\(0\)\s?|[ .-]?)\(?\d{1,5}\)?(?:[ .\-/]?\d{2,6}){1,5}"),
            (_B, r"00[1-9]\d(?:[ .\-/]?\(?\d{2,6}\)?){2,5}"),
            (r"(?<![\w.+/-])", r"(?:1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}"),
            (r"(?<![\w.+/-])", r"\(0\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{2,4}"),
            (_B, r"1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}"),
            (_B, r"\d{3}([ .-])\d{3}\1\d{4}"),
            (_B, r"0\d{3,4}[ -]\d{3}[ -]?\d{3}"),
            (_B, r"0\d(?:[ .-]\d{2}){4}"),
            (_B, r"0\d{2,4}/\d{3,8}(?:-\d{1,4})?"),
            (_B, r"[1-9]\d{9}"),
            (_B, r"0\d{9,10}"),
        )
    )
)
_AGAINST = re.compile(r"(?:order|orders|isbn|version|batch|total|invoice|dataset|gauge read|reference|case|file|section|vol\.?|pp\.?|no\.|№|§|bestellung|commande|pedido|ordine|заказ)[\s:#]*$", re.I)
_DIGITS = re.compile(r"\d(?:[ ()./-]{0,3}\d){5,}")

_NAME_WORD = r"[A-ZÀ-ÞŠŽ][\w'’-]*"
_PARTICLE = r"(?:de la |de l['’]|de los |de las |del |dei |delle |della |degli |dell['’]|des |du |de |do |da |dos |das |d['’]|di )?"
_NUMBER = r"\d{1,4}(?: ?[a-z](?![a-z]))?"
_STREETS = "Street|St|Lane|Ln|Road|Rd|Avenue|Ave|Mews|Close|Cl|Court|Ct|Row|End|Square|Sq|Terrace|Drive|Dr|Way|Place|Pl|Crescent|Gardens|Hill|Walk|Alley|Quay|Yard|Green|Parade|Boulevard|Blvd"
_FLAT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite)\.? ?\d{1,4}[a-zA-Z]?, ?)?"
_FLAT_AFTER = r"(?:, ?(?:Flat|Apt|Apartment|Unit|Suite|Appt|apt|interno|int\.|piso|Whg)\.? ?\d{1,4}[a-zA-Z]?)?"
# Number first: tried at every number.
_NUMBER_FIRST = [
    re.compile(rf"{_NUMBER},? (?:{_NAME_WORD} ){{1,3}}(?:{_STREETS})\b{_FLAT_AFTER}"),
    re.compile(rf"\d{{1,4}} ?(?:bis|ter|[a-z])?,? ?(?:rue|impasse|avenue|boulevard|allée|place|chemin|quai|cours|route|passage|square|ruelle|sentier|Rue|Impasse|Avenue|Boulevard|Allée|Place|Chemin|Quai) {_PARTICLE}{_NAME_WORD}(?: {_PARTICLE}{_NAME_WORD})*{_FLAT_AFTER}"),
]
_FLAT_BEFORE = re.compile(r"(?<![\w-])(?:Flat|Apt|Apartment|Unit|Suite)\.? ?\d{1,4}[a-zA-Z]?, ?$")
_HOUSE = re.compile(r"\d+")
_RUE = frozenset("abcipqrst")  # how the words for a street begin that follow a number
# A word that ends like a street, before a number.
_COMPOUND_ENDS = tuple("straße strasse str. gasse weg allee platz ufer ring damm hof steig chaussee straat laan gracht kade plein dijk singel steeg dreef".split())
_COMPOUND = re.compile(rf"(?:(?:Alte|Alter|Neue|Große|Kleine|Obere|Untere|Oude|Nieuwe|Lange|Korte|Hoge) )?(?<!\w)[A-ZÄÖÜ][\wß-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|ring|damm|hof|steig|chaussee|straat|laan|gracht|kade|plein|dijk|singel|steeg|dreef) {_NUMBER}{_FLAT_AFTER}")
_BEFORE_COMPOUND = re.compile(r"(?<!\w)(?:Alte|Alter|Neue|Große|Kleine|Obere|Untere|Oude|Nieuwe|Lange|Korte|Hoge) $")
# Street word first: looked for only in texts that hold one.
_WORD_FIRST = [
    (
        "Calle |Plaza |Avenida |Paseo |Camino |Ronda |Travesía |Carrera |C/ |Via |Viale |Piazza |Corso |Vicolo |Largo |Strada |Piazzale |Rua |Praça |Travessa |Alameda |Estrada |Beco |calle |plaza |avenida |paseo |via |viale |piazza |rua |praça |travessa |alameda |largo ".split("|"),
        re.compile(rf"(?<!\w)(?:Calle|Plaza|Avenida|Paseo|Camino|Ronda|Travesía|Carrera|C/|Via|Viale|Piazza|Corso|Vicolo|Largo|Strada|Piazzale|Rua|Praça|Travessa|Alameda|Estrada|Beco|calle|plaza|avenida|paseo|via|viale|piazza|rua|praça|travessa|alameda|largo) {_PARTICLE}{_NAME_WORD}(?: {_PARTICLE}{_NAME_WORD})*,? ?(?:n\.?[ºo°]?\.? ?|núm\.? ?|nr\.? ?)?{_NUMBER}{_FLAT_AFTER}"),
    ),
    (
        ["Am ", "An der ", "An den ", "Im ", "In der ", "Auf dem ", "Auf der ", "Zum ", "Zur ", "Unter den ", "Hinter der "],
        re.compile(rf"(?<!\w)(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den|Hinter der) [A-ZÄÖÜ][a-zäöüß]+ {_NUMBER}(?![\w.]|[./-]\d)"),
    ),
    (
        ["ул.", "улица", "вул.", "вулиця", "пр.", "проспект", "пер.", "площадь", "площа", "бульвар"],
        re.compile(r"(?<!\w)(?:ул\.|улица|вул\.|вулиця|пр\.|проспект|пер\.|площадь|площа|бульвар) [А-ЯЁІЇЄҐ][\w-]+(?: [А-ЯЁІЇЄҐ][\w-]+)*,? ?(?:д\. ?|буд\. ?)?\d{1,4}[а-я]?(?:, ?(?:кв\.) ?\d{1,4})?"),
    ),
    (["οδός", "Οδός", "λεωφόρος", "Λεωφόρος"], re.compile(r"(?<!\w)(?:οδός|Οδός|λεωφόρος|Λεωφόρος) [Α-ΩΆ-Ώ]\w+(?: [Α-ΩΆ-Ώ]\w+)*,? \d{1,4}[α-ω]?")),
]


def _addresses(text: str) -> list[tuple[int, int]]:
    """Every reading of a street and number, by where it begins; those of a number itself first."""
    out = []
    for h in _HOUSE.finditer(text):
        at, end = h.span()
        before, after = text[at - 1 : at], text[end : end + 1]
        if end - at > 4 or before == "-" or before.isalnum() or before == "_":
            continue
        third = text[end + 1 : end + 2]
        if after.isalpha() or after == "," or after == " " and (third.isupper() or third in _RUE or third.islower() and not text[end + 2 : end + 3].islower()):
            for p in _NUMBER_FIRST:
                m = p.match(text, at)
                if m:
                    flat = _FLAT_BEFORE.search(text[max(0, at - 24) : at])
                    out.append((at - (len(flat.group()) if flat else 0), m.end()))
                    break
        if at > 4 and before == " " and text.endswith(_COMPOUND_ENDS, max(0, at - 12), at - 1):
            word = max(text.rfind(" ", 0, at - 1), text.rfind("\n", 0, at - 1)) + 1
            adjective = _BEFORE_COMPOUND.search(text[max(0, word - 9) : word])
            for k in range(word, at - 1):  # past marks before the word
                m = _COMPOUND.match(text, k)
                if m:
                    out.append((k - (len(adjective.group()) if adjective and k == word else 0), m.end()))
                    break
    for words, p in _WORD_FIRST:
        if any(w in text for w in words):
            out += [m.span() for m in p.finditer(text)]
    return sorted(out, key=lambda x: x[0])


# --- names ----------------------------------------------------------------------------------------

_LETTER = "[A-Za-z" + chr(0xC0) + "-" + chr(0xD6) + chr(0xD8) + "-" + chr(0xF6) + chr(0xF8) + "-" + chr(0x24F) + "]"
_TOKEN = re.compile(rf"{_LETTER}+(?:['’-]{_LETTER}+)*")
_ORG_WORDS = set("university department dept institute inst laboratory lab hospital hosp company co corporation corp incorporated inc limited ltd authority auth association assn group grp brothers bros international intl national natl manufacturing mfg saint st the of and research".split())
_NOT_SURNAMES = _ORG_WORDS | set(
    "as at in on by for to after since even meanwhile shortly under none according contact dear hello hi hola hallo ciao olá bonjour beste liebe flat apt send call order version batch section use see her his my please "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "außerdem laut telefonisch am der die das ein eine bitte ohne wegen niemand volgens bovendien de het een par selon le la les un une sans merci además según el los las una sin se secondo inoltre il segundo além o os as uma sem "
    "кроме как второй метод компания выручка мост урожай".split()
)
_CYRILLIC_PAIR = re.compile(r"(?<![\w-])[А-ЯЁІЇЄҐ][а-яёіїєґ'’]+(?:-[А-ЯЁІЇЄҐ][а-яёіїєґ'’]+)? (?:[А-ЯЁІЇЄҐ]\. ?)?[А-ЯЁІЇЄҐ][а-яёіїєґ'’]+(?:-[А-ЯЁІЇЄҐ][а-яёіїєґ'’]+)?(?![\w»-])")
_CYRILLIC_INITIAL = re.compile(r"(?<![\w.«-])[А-ЯЁІЇЄҐ]\. ?(?:[А-ЯЁІЇЄҐ]\. ?)?[А-ЯЁІЇЄҐ][а-яёіїєґ'’]{2,}(?![\w»-])")
_GREEK_PAIR = re.compile(r"(?<![\w-])[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰς]+ (?:[Α-Ω]\. ?)?[Α-ΩΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰς]+(?![\w»-])")
_CYRILLIC_FIRST = set("компания компанія кроме как мост міст номер выручка виторг добрый добрий".split())
_ARABIC_TOKEN = "[ؠ-يّٮ-ۓ‌]+"
_ARABIC_CONTEXT = re.compile(rf"(?:(?<=يختلف )|(?<=سلّم ))({_ARABIC_TOKEN} {_ARABIC_TOKEN})(?= )|(?<= و )({_ARABIC_TOKEN} {_ARABIC_TOKEN})(?= حول)")
_ARABIC_PAIR = re.compile(rf"(?<![ؠ-ۿ])({_ARABIC_TOKEN}) {_ARABIC_TOKEN}")
_CHINESE = re.compile(rf"(?:(?<![一-鿿])|(?<=[和与前由对被给者]))[{CHINESE_SURNAMES}][一-鿿]{{2}}(?=[和与对于又把将说在的，。、：\s]|$)")
_JAPANESE_NAME = r"[一-鿿々][一-鿿ヶ々]{1,2}(?:[一-鿿]{2}|[ぁ-ん]{3}|[ぁ-ん]{1,2}[一-鿿])"
_JAPANESE = re.compile(rf"(?:(?<![一-鿿ぁ-んァ-ヶー々])|(?<=と))(?!議事録|二人目|校閲者|電話番|倉庫)(?:{_JAPANESE_NAME})(?=は\d{{4}}年|は語句|と[A-Za-zÀ-ɏ一-鿿]|さん|氏|様|\s*$|\s*\n)", re.M)
_KANA = re.compile("[ぁ-んァ-ヶ]")
_CYRILLIC, _GREEK, _ARABIC, _IDEOGRAPH = re.compile("[А-яЁІЇЄҐёіїєґ]"), re.compile("[Α-ωΆ-Ώά-ώ]"), re.compile("[ؠ-ۓ]"), re.compile("[一-鿿]")
_TITLES = frozenset(TITLES) | {"monsieur", "madame", "señor", "señora", "signora", "signor"}
_BODIES = frozenset("agency archive army bank board bureau church club commission committee congress council court embassy federation foundation government library members ministry museum network office parliament party police press school senate society staff team union".split())
_SAYS = frozenset("wrote writes said says asked asks told met thinks thought believes replied answered explained argued smiled lives".split())
_MEETS = frozenset("met asked told thanked hired phoned".split())
_GREETING = re.compile(r"(?:^|\n)\s*(?:dear|hello|hi|hey|beste|bonjour|hola|ciao|olá|hallo|liebe|lieber|cher|chère|caro|cara|estimad[oa]|prezad[oa]|querid[oa]|gentile)\s+$", re.I)


def folded(word: str) -> str:
    """Lower case without accents."""
    w = word.lower().replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


def one_error(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours, or none, makes a of b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x == y[1:] or x[1:] == y or (len(x) == len(y) and x[:2] == y[:2][::-1] and x[2:] == y[2:])


class NameParts:
    """Given names and surnames of a catalogue of people ("Given Surname"), and what they tell about others;
    words that several of its organisations share, and how its places end, speak against a name."""

    def __init__(self, full_names: list[str], organisations: list[str] = (), places: list[str] = ()):
        shared = Counter(folded(w) for o in organisations for w in set(_TOKEN.findall(o)))
        self.org_words = {w for w, n in shared.items() if n >= 3} | _ORG_WORDS
        self.places = {folded(x) for x in places}
        self.place_ends = {e for e, n in Counter(x[-4:] for x in self.places).items() if n >= 3}
        parts = [n.split() for n in full_names if n and len(n.split()) >= 2]
        self.given = {folded(p[0]) for p in parts} | set(NICKNAMES) | {g for x in NICKNAMES.values() for g in x.split()}
        self.given |= {p[0].lower().replace("ö", "oe").replace("ø", "oe").replace("ü", "ue").replace("ä", "ae") for p in parts}
        self.surnames = {folded(w) for p in parts for w in p[-1].split("-")} | {folded(p[-1]) for p in parts}
        ends = Counter(folded(w)[-3:] for w in {x for p in parts for x in p[-1].split("-")} if len(w) > 4)
        self.ends = {e for e, n in ends.items() if n >= 4}
        self._near: dict[str, list[str]] = {}
        for g in self.given:
            if len(g) >= 4 and g not in ALSO_WORDS:
                for k in {g, *(g[:i] + g[i + 1 :] for i in range(len(g)))}:
                    self._near.setdefault(k, []).append(g)
        self.is_given_or_near = remembered(200_000)(self._is_given_or_near)
        self.like_surname = remembered(200_000)(self._like_surname)
        self.like_place = remembered(200_000)(self._like_place)
        self.org_word = remembered(200_000)(self._org_word)
        self.no_surname = remembered(200_000)(self._no_surname)
        self.other_words = {folded(w) for o in (*organisations, *places) for w in _TOKEN.findall(o)}

    def _is_given_or_near(self, word: str) -> int:
        """2: a given name, 1: one with a typing error, 0: neither."""
        f = folded(word)
        if f in self.given:
            return 2
        if not 4 <= len(f) <= 30 or f in self.org_words or f in _NOT_SURNAMES or word.lower() in _NOT_SURNAMES:
            return 0
        for k in (f, *(f[:i] + f[i + 1 :] for i in range(len(f)))):
            for g in self._near.get(k, ()):
                if one_error(f, g):
                    return 1
        return 0

    def _like_place(self, word: str) -> bool:
        f = folded(word)
        return f in self.places or f[-4:] in self.place_ends

    def _org_word(self, word: str) -> bool:
        return folded(word) in self.org_words

    def _no_surname(self, word: str) -> bool:
        return word.lower() in _NOT_SURNAMES or folded(word) in self.org_words

    def place_or_org(self, word: str) -> bool:
        """Whether an organisation or a place of the catalogue holds the word."""
        return folded(word) in self.other_words

    def joined_given(self, word: str) -> bool:
        """A given name and a surname typed as one word."""
        return any(word[i].isupper() and word[i - 1].islower() and self.is_given_or_near(word[:i]) == 2 for i in range(3, len(word) - 3))

    def _like_surname(self, word: str) -> bool:
        f = folded(word)
        return f in self.surnames or (len(f) >= 5 and any(p in self.surnames or p[-3:] in self.ends for p in (f, f.split("-")[-1])))


def _latin_names(text: str, parts: NameParts) -> list[tuple[int, int]]:
    tokens = list(_TOKEN.finditer(text))
    words = [m.group() for m in tokens]
    n = len(words)
    given = parts.given
    # Where a name may begin or be told by: capitals, and given names typed small.
    marks = [k for k, w in enumerate(words) if w[0].isupper() or w in given or not w.isascii() and folded(w) in given]
    if not marks:
        return []
    out: list[tuple[int, int]] = []
    lower_text = text.islower()
    begin, stop = (lambda k: tokens[k].start()), (lambda k: tokens[k].end())

    def cap(k: int) -> bool:
        return words[k][0].isupper()

    def gap(k: int) -> str:
        return text[tokens[k].end() : tokens[k + 1].start()] if k + 1 < n else ""

    def surname(k: int, strict: bool) -> bool:
        if not 0 <= k < n:
            return False
        w = words[k]
        if len(w) < 3 or parts.no_surname(w):
            return False
        return parts.like_surname(w) if strict or not cap(k) else True

    def org_next(k: int) -> bool:
        return k + 1 < n and cap(k + 1) and gap(k) in (" ", " & ", "-") and (parts.org_word(words[k + 1]) or folded(words[k + 1]) == "and")

    def full_stop(k: int) -> bool:
        return text[stop(k) : stop(k) + 1] == "."

    done = -1
    for k in marks:
        if k <= done:
            continue
        w, upper = words[k], cap(k)
        s, e, after = begin(k), stop(k), gap(k)
        if len(w) == 1:
            # N. Surname; N Surname if the surname is known; Q. at the start of a line is a speaker
            if upper and k + 1 < n and cap(k + 1) and (after == ". " and surname(k + 1, False) or after == " " and surname(k + 1, True)) and not org_next(k + 1) and not (s and (text[s - 1] == "-" or text[s - 1].isascii() and text[s - 1].isalnum())):
                speaker = w == "Q" and after == ". " and text[max(0, s - 80) : s].rstrip(" ")[-1:] in ("", "\n")
                if not speaker and not (k and len(words[k - 1]) == 1 and cap(k - 1) and words[k - 1] != "Q" and gap(k - 1) in (". ", ".")):
                    out.append((s, stop(k + 1)))
                    done = k + 1
            continue
        level = parts.is_given_or_near(w)
        if upper and not level and len(w) <= 60 and not w[1:].islower() and parts.joined_given(w):
            out.append((s, e))
            continue
        if level and (upper or level == 2):
            # Given [X.] Surname
            j = k
            while j + 1 < n and len(words[j + 1]) == 1 and cap(j + 1) == upper and (gap(j) == " " or gap(j) == ". " and j > k):
                j += 1
            sep = after if j == k else gap(j)
            known_before = k > 0 and cap(k - 1) and gap(k - 1) == " "
            if j + 1 < n and (sep == " " or j > k and sep == ". ") and cap(j + 1) == upper and surname(j + 1, not upper or level == 1 and known_before) and not (level == 1 and org_next(j + 1)):
                nxt = words[j + 1]
                if not (folded(nxt) in given and surname(k, True) and not parts.like_surname(nxt)):
                    last = j + 1
                    if upper and last + 1 < n and cap(last + 1) and gap(last) == " " and surname(last + 1, True) and not org_next(last + 1):
                        last += 1  # two surnames
                    out.append((s, stop(last)))
                    done = last
                    continue
            # Surname, Given [X.]  and  Surname Given
            between = gap(k - 1) if k else ""
            if between in (", ", " ") and cap(k - 1) == upper and surname(k - 1, level == 1 or not upper) and not org_next(k) and not (out and out[-1][1] >= begin(k - 1)):
                before = words[k - 1]
                led = k > 1 and gap(k - 2) == " " and cap(k - 2)
                comma = between == ", " and not parts.like_place(before) and not (led and words[k - 2].lower() not in _NOT_SURNAMES)
                if parts.like_surname(before) or comma or between == " " and level == 2 and len(before) > 4 and not led:
                    end = e
                    if k + 1 < n and after == " " and len(words[k + 1]) == 1 and cap(k + 1) and full_stop(k + 1):
                        end = stop(k + 1) + 1
                    out.append((begin(k - 1), end))
                    continue
            if level == 2:
                f = folded(w)
                greeted = bool(_GREETING.search(text[max(0, s - 14) : s]))
                if greeted or upper and f not in NICKNAMES or lower_text and f not in NICKNAMES and f not in ALSO_WORDS:
                    if not (k + 1 < n and upper and after in (" ", "-", " & ") and cap(k + 1) and words[k + 1].lower() in _ORG_WORDS):
                        out.append((s, e))
                        continue
            elif _GREETING.search(text[max(0, s - 14) : s]):
                out.append((s, e))
                continue
            # a short form alone, beside a verb of people
            if level == 2 and upper and (k and words[k - 1] in _MEETS and gap(k - 1) == " " or k + 1 < n and words[k + 1] in _SAYS and after == " "):
                out.append((s, e))
                continue
        if not upper or k + 1 >= n or not cap(k + 1):
            continue
        # Surname, X.
        if after == ", " and len(words[k + 1]) == 1 and full_stop(k + 1) and surname(k, False) and not parts.like_place(w) and not (k and gap(k - 1) in (" ", " & ") and cap(k - 1) and not parts.like_surname(w)):
            out.append((s, stop(k + 1) + 1))
            done = k + 1
            continue
        # an unknown given name before a surname of the catalogue
        if after == " " and len(w) > 2 and folded(words[k + 1]) in parts.surnames and w.lower() not in _NOT_SURNAMES:
            third = gap(k + 1) if k + 2 < n else ""
            if not (third == " " and cap(k + 2) and not parts.is_given_or_near(words[k + 2])):
                if not parts.is_given_or_near(words[k + 1]) and not parts.is_given_or_near(words[k + 2] if third in (" ", ", ") else ""):
                    out.append((s, stop(k + 1)))
                    done = k + 1
                    continue
        # Two capitalised words that no catalogue holds, told as a person's by a title before them or a verb of people beside them
        if after == " " and len(w) > 1 and len(words[k + 1]) > 1:
            titled = k > 0 and words[k - 1].lower() in _TITLES and gap(k - 1) in (" ", ". ")
            last = k + 2 if titled and k + 2 < n and cap(k + 2) and len(words[k + 2]) > 1 and gap(k + 1) == " " else k + 1
            opens = k == 1 or k > 1 and gap(k - 2).rstrip(" ")[-1:] in (".", "!", "?", "\n")  # the word before has a capital as it opens a sentence
            alone = (not (k and cap(k - 1) and gap(k - 1) == " ") or opens) and not (last + 1 < n and cap(last + 1) and gap(last) == " ")
            says = alone and last + 1 < n and words[last + 1] in _SAYS and gap(last) == " "
            met = alone and k > 0 and words[k - 1] in _MEETS and gap(k - 1) == " "
            if (titled or says or met) and not any(x.lower() in _BODIES or parts.no_surname(x) or parts.like_place(x) or parts.place_or_org(x) for x in words[k : last + 1]):
                out.append((s, stop(last)))
                done = last
    return out


def _other_scripts(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    if _CYRILLIC.search(text):
        for p in (_CYRILLIC_PAIR, _CYRILLIC_INITIAL):
            out += [m.span() for m in p.finditer(text) if m.group().split()[0].lower() not in _CYRILLIC_FIRST]
    if _GREEK.search(text):
        out += [m.span() for m in _GREEK_PAIR.finditer(text) if m.group().split()[0].lower() not in _CYRILLIC_FIRST]
    if _ARABIC.search(text):
        out += [m.span(1) if m.group(1) else m.span(2) for m in _ARABIC_CONTEXT.finditer(text)]
        out += [m.span() for m in _ARABIC_PAIR.finditer(text) if m.group(1) in ARABIC_GIVEN]
    if _IDEOGRAPH.search(text):
        kana = bool(_KANA.search(text))
        for m in re.finditer(r"[^\n。]+(?:。|\n|$)", text):
            line = m.group()
            japanese = kana and (_KANA.search(line) or not re.search("[。，]", line))
            found = _JAPANESE.finditer(line) if japanese else _CHINESE.finditer(line)
            out += [(m.start() + x.start(), m.start() + x.end()) for x in found if not (x.group()[0] == "于" and line[: x.start()].endswith("由"))]
    return out


def _find_names(text: str, parts: NameParts) -> list[tuple[int, int]]:
    out = _latin_names(text, parts)
    if not text.isascii():
        out += _other_scripts(text)
    return out


def _emails(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("@")
    while at >= 0:
        k = at
        while k and text[k - 1] in _LOCAL_SIGNS:
            k -= 1
        domain = _DOMAIN.match(text, at + 1)
        if domain and k < at and _LOCAL.match(text, k, at):
            out.append((k, domain.end()))
        at = text.find("@", at + 1)
    return out


def find(text: str, parts: NameParts, spelled: list[tuple[int, int]] = ()) -> list[Span]:
    """(kind, start, end) in a plain text, in order and apart; `spelled` are its runs of digits that were words."""
    taken: list[Span] = []
    claims = Claims()

    def add(kind: str, s: int, e: int) -> None:
        if claims.take(s, e):
            taken.append((kind, s, e))

    for s, e in _emails(text):
        add("email", s, e)
    # Every number that can be one of these has six digits or more, close together: only those stretches are read closely.
    stretches = [(max(0, m.start() - 8), min(len(text), m.end() + 6)) for m in _DIGITS.finditer(text)]
    for kind, pattern in (("identity", IDENTITY), ("phone", PHONE)):
        for s, e in stretches:
            for m in pattern.finditer(text, s, e):
                digits = sum(c.isdigit() for c in m.group())
                if (kind == "identity" or 9 <= digits <= 15) and not _AGAINST.search(text[max(0, m.start() - 16) : m.start()]):
                    add(kind, *m.span())
    for s, e in spelled:
        add("phone", s, e)
    for s, e in _addresses(text):
        add("address", s, e)
    for s, e in sorted(set(_find_names(text, parts)), key=lambda x: (x[0] - x[1], x)):
        add("name", s, e)
    return sorted(taken, key=lambda x: x[1])


def occurrences(text: str | None, parts: NameParts) -> list[Span]:
    """(kind, start_char, end_char) in the text as stored: what `find` sees in the plain text, carried back through the map of
    each step."""
    if not text:
        return []
    canonical = canonical_edits(text)
    same = apply_edits(text, canonical)
    plain, spelled = plain_edits(same)
    found = find(apply_edits(same, plain), parts, moved(plain, spelled))
    for edits in (plain, canonical):
        if edits:
            back = Offsets(edits)
            found = [(kind, *back.span(a, b)) for kind, a, b in found]
    return found


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with each occurrence replaced by a placeholder of its type."""
    if text is None:
        return None
    return apply_edits(text, [(s, e, f"[{kind.upper()}]") for kind, s, e in spans])


# --- documents ------------------------------------------------------------------------------------

FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))
MAX_CATALOGUE = 2_000_000  # names of the catalogue that a broadcast may hold


def catalogue_names(catalogue: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """People, organisations and places of a catalogue (kb_name, entity_type); its size is checked."""
    rows = catalogue.where(F.col("kb_name").isNotNull()).select("kb_name", "entity_type").limit(MAX_CATALOGUE + 1).collect()
    if len(rows) > MAX_CATALOGUE:
        raise ValueError(f"the catalogue holds more than {MAX_CATALOGUE} names")
    of = lambda kind: sorted(r[0] for r in rows if r[1] == kind)
    return of("PER"), of("ORG"), of("LOC")


def _found_column(documents: DataFrame, catalogue: DataFrame):
    shared = documents.sparkSession.sparkContext.broadcast(catalogue_names(catalogue))

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        parts = NameParts(*shared.value)
        for texts in batches:
            yield texts.map(lambda t: occurrences(t, parts))

    return found("text")


def personal_information(documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(doc_id, kind, start_char, end_char): each occurrence, offsets into the text as stored.

    No shuffle: every text is read where it lies, in one pass."""
    d = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    d = d.select("doc_id", F.explode(_found_column(d, catalogue)).alias("x"))
    return d.select("doc_id", "x.kind", "x.start_char", "x.end_char")


def masked_documents(documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(doc_id, masked_text, n_replaced): every document with placeholders; null texts stay null."""
    d = documents.select("doc_id", "text")
    d = d.withColumn("found", _found_column(d, catalogue))
    piece = F.transform(
        "found",
        lambda x, i: F.concat(
            F.substring("text", F.when(i == 0, F.lit(1)).otherwise(F.element_at("found", F.greatest(i, F.lit(1)))["end_char"] + 1), x["start_char"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at("found", F.greatest(i, F.lit(1)))["end_char"])),
            F.lit("["), F.upper(x["kind"]), F.lit("]"),
        ),
    )
    rest = F.substring("text", F.when(F.size("found") > 0, F.element_at("found", -1)["end_char"]).otherwise(F.lit(0)) + 1, F.length("text"))
    return d.select("doc_id", F.when(F.col("text").isNotNull(), F.concat(F.array_join(piece, ""), rest)).alias("masked_text"), F.size("found").alias("n_replaced"))
