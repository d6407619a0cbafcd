"""Names found by how they are written: runs of capitalised words, judged by what they hold and what stands before them.

A text is read as tokens; every token becomes one letter of a code (may it begin a run, is it tied to the token before),
so that the runs are the matches of one regular expression over the code. Each kind of evidence is a row of EVIDENCE with a
rank; the evidence of least rank that a run shows names its label and confidence. Everything is linear in the text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from ..functions.text import SPACE
from .claims import Claims

Found = tuple[int, int, str, str, str, float]

# --- fixed values: words that results depend on ------------------------------------------------------
COMPANY_ENDINGS = (
    "inc. inc corp. corp ltd. ltd llc co. plc foundation institute university college bank group agency gmbh ag kg sa s.a. s.l. s.r.l. spa nv bv pty ab limited corporation incorporated company holding holdings"
).split()
TITLES = "mr. mr ms. ms mrs. mrs dr. dr prof. prof".split()
PLACE_WORDS = "in from at to near aus nach bei von en de à dans por sur".split()
OFFICES = "ceo cto cfo vp president chairman director".split()
PRONOUNS = "the a an he she it they we i you".split()
SENTENCE_STARTERS = (
    "the a an this that these those it he she we they in on at to for from by with and but or so yet if because contact call email visit please see note today yesterday tomorrow now then "
    "what where when who why how is are was were be been have has had"
).split()
PLACE_PREFIXES = "united new south north west east great".split()
COMPANIES = (
    "google apple microsoft amazon facebook meta tesla twitter ibm intel nvidia oracle cisco samsung sony toyota honda bmw mercedes volkswagen nasa fbi cia nsa nato un eu bbc cnn nbc cbs abc fox nyt wsj reuters "
    "bloomberg spotify netflix uber airbnb paypal visa mastercard amex"
).split()
COMPANIES_CJK = "ソニー トヨタ ホンダ 任天堂 サムスン ファーウェイ アリババ テンセント 华为 阿里巴巴 腾讯 百度 小米".split()
PLACES = (
    "paris london tokyo berlin rome madrid moscow beijing shanghai dubai singapore sydney toronto chicago boston california texas florida washington europe asia africa america australia china india japan germany "
    "france italy spain brazil mexico russia korea canada uk usa"
).split() + ["new york"]
PLACES_CJK = "東京 大阪 京都 北京 上海 香港 ソウル 台北 中国 日本 韓国 アメリカ イギリス フランス ドイツ".split()
GIVEN_NAMES = (
    "john jane mary james robert michael william david richard joseph thomas charles barack donald joe george bill vladimir emmanuel boris narendra justin elon jeff mark steve tim satya sundar albert isaac stephen "
    "neil peter paul matthew andrew philip simon marie angela hillary nancy kamala michelle melania jill theresa ursula"
).split()
THRESHOLD = 0.35
# Rank, evidence, label, confidence. The first two make a run no name at all.
EVIDENCE = [
    (1, "pronoun", "", 0.0),
    (2, "office", "", 0.0),
    (3, "company ending", "ORG", 0.85),
    (4, "listed company", "ORG", 0.80),
    (5, "listed place", "LOC", 0.80),
    (6, "listed given name", "PER", 0.75),
    (7, "after a title", "PER", 0.80),
    (8, "with a title", "PER", 0.75),
    (9, "after a place word", "LOC", 0.70),
    (10, "place prefix", "LOC", 0.65),
    (11, "two words", "PER", 0.60),
    (12, "joined by of", "ORG", 0.65),
    (13, "three words or more", "ORG", 0.50),
    (14, "opens the text", "PER", 0.30),
    (15, "one word", "PER", 0.45),
]
# -----------------------------------------------------------------------------------------------------

_BY_RANK = {rank: (name, label, sure) for rank, name, label, sure in EVIDENCE}
# What a first word shows by itself, at its least rank.
_FIRST_WORD = {w: rank for rank, words in ((6, GIVEN_NAMES), (5, PLACES), (4, COMPANIES)) for w in words}
_ALONE = {w: rank for rank, words in ((2, OFFICES), (1, PRONOUNS)) for w in words}
_ENDINGS, _TITLES, _STARTERS, _AFTER, _PREFIXES = map(frozenset, (COMPANY_ENDINGS, TITLES, SENTENCE_STARTERS, PLACE_WORDS, PLACE_PREFIXES))

_SPACE = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), SPACE)
_TOKEN = re.compile(f"[^{_SPACE}]+")
_RUN = re.compile("[Aa][AB]*")
_LEAD, _TAIL = re.compile(r"[\W_]*"), re.compile(r"[\W_]*$")
_CJK = re.compile("|".join(sorted(COMPANIES_CJK + PLACES_CJK, key=lambda w: (-len(w), w))))
_CLOSING = frozenset(")]}.!?")


def bare(word: str) -> str:
    """Without marks at both ends."""
    return _TAIL.sub("", word[_LEAD.match(word).end() :])


def run_code(words: list[str]) -> str:
    """A letter a token: A or a may begin a run, B or b may not; capitals are tied to the token before.

    A token is tied if it has a capital, or is `of` or `the` before a capital, unless the token before closes a group (a
    bracket, a full stop) and it is no company ending itself."""
    heads = [w[_LEAD.match(w).end() :][:1] for w in words]
    upper = [h.isupper() for h in heads] + [False]
    code = []
    for k, w in enumerate(words):
        low = w.lower()
        tied = k > 0 and (upper[k] or low in ("of", "the") and upper[k + 1]) and (words[k - 1][-1] not in _CLOSING or low in _ENDINGS or bare(low) in _ENDINGS)
        begins = upper[k] and bare(low) not in _STARTERS
        code.append(("A" if begins else "B") if tied else ("a" if begins else "b"))
    return "".join(code)


def evidence(words: list[str], before: str | None, opens: bool) -> int:
    """The least rank of what a run of lower-case words shows."""
    n, first = len(words), words[0]
    ranks = [15 if n == 1 else 11 if n == 2 else 13]
    if n == 1:
        ranks.append(_ALONE.get(_TAIL.sub("", first), 15))
        if opens:
            ranks.append(14)
    if _TAIL.sub("", words[-1]) in _ENDINGS:
        ranks.append(3)
    ranks.append(min(_FIRST_WORD.get(_TAIL.sub("", first), 15), _FIRST_WORD.get(" ".join(words), 15)))
    if before is not None:
        if before.rstrip(".") in _TITLES:
            ranks.append(7)
        if before in _AFTER:
            ranks.append(9)
    if n >= 2 and first.rstrip(".") in _TITLES:
        ranks.append(8)
    if n == 2 and first in _PREFIXES:
        ranks.append(10)
    if n >= 3 and words[1] == "of":
        ranks.append(12)
    return min(ranks)


def heuristic_spans(text: str, threshold: float = THRESHOLD) -> list[Found]:
    """(start, end, surface, label, evidence, confidence): runs, and listed names in scripts without capitals.

    A title before a run belongs to it. The surface is the stretch of the text itself, without marks at its ends."""
    out: set[Found] = {(m.start(), m.end(), m.group(), "ORG" if m.group() in COMPANIES_CJK else "LOC", "listed", 0.9) for m in _CJK.finditer(text)}
    tokens = [(m.start(), m.group()) for m in _TOKEN.finditer(text)]
    words = [w for _, w in tokens]
    for m in _RUN.finditer(run_code(words)):
        k, last = m.start(), m.end() - 1
        if k and words[k - 1].lower().rstrip(".") in _TITLES:
            k -= 1
        start = tokens[k][0] + _LEAD.match(words[k]).end()
        surface = _TAIL.sub("", text[start : tokens[last][0] + len(words[last])])
        if not surface:
            continue
        rank = evidence([w.lower() for w in _TOKEN.findall(surface)], words[k - 1].lower() if k else None, k == 0)
        name, label, sure = _BY_RANK[rank]
        if label and sure >= threshold:
            out.add((start, start + len(surface), surface, label, name, sure))
    return sorted(out)


# --- patterns of the rule extractor: fixed values, in the order in which they claim ---------------------
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
RULE_ORGANISATIONS = (
    "NASA FBI CIA NSA NIH FDA CDC EPA WHO NATO UN EU IMF WTO CERN MIT UCLA DARPA OECD OPEC IEEE ACM AWS GCP IBM HP AMD ARM NVIDIA Intel Apple Google Microsoft Amazon Meta OpenAI Anthropic DeepMind Pfizer Moderna "
    "Rivian BYD Netflix Uber Airbnb NeurIPS ICML ICLR CVPR ACL EMNLP NAACL IPCC SEC FCC DOJ DOE DOD USDA HUD IRS FEMA OSHA NOAA NSF USPTO FTC NIST DOT VA SSA SBA FAA TSA ICE CBP USCIS NFL NBA MLB NHL MLS FIFA UEFA "
    "IOC NCAA PGA ATP WTA UFC WWE ESPN LEICESTERSHIRE DERBYSHIRE YORKSHIRE SURREY ESSEX WARWICKSHIRE SUSSEX MIDDLESEX HAMPSHIRE SOMERSET KENT LANCASHIRE GLOUCESTERSHIRE NOTTINGHAMSHIRE NORTHAMPTONSHIRE WORCESTERSHIRE DURHAM"
).split()
RULE_PLACES = [
    r"New\s+York(?:\s+City)?", r"San\s+Francisco", r"Los\s+Angeles", r"Washington(?:\s+D\.?C\.?)?", r"Tokyo\s+Bay", r"United\s+States", r"United\s+Kingdom", r"European\s+Union", "Asia-Pacific", r"North\s+America",
    r"South\s+America", r"Atlantic\s+Ocean", r"Pacific\s+Ocean", r"Amazon\s+River", "Tokyo", "Berlin", "Paris", "London", "Beijing", "Shanghai", "Mumbai", "Sydney", "Moscow", "Dubai", "Seoul", "Singapore", r"Hong\s+Kong",
    "Brazil", "Peru", "Colombia", "China", "Japan", "Germany", "France", "Italy", "Spain", "Canada", "Australia", "India", "Russia", "Mexico", "Argentina", "Chile", "Ukraine", "California", "Texas", "Florida", "Illinois",
    "Seattle", "Chicago", "Boston", "Atlanta", "Denver", "Phoenix", "Portland", "Miami", "Cupertino", "Redmond", "Wuhan", "Geneva",
]
RULE_ENDINGS = r"Inc\.? Corp\.? Corporation Ltd\.? LLC GmbH University Institute Foundation Laboratory Labs? Company Technologies Systems Research Group Partners Associates Agency Commission Court Council Board Committee Organization Organisation Bank Reserve Museum".split()
RULE_TITLES = r"Dr\. Mr\. Mrs\. Ms\. Prof\. Chairman CEO President Director Justice General Commissioner Coach Governor Senator Mayor".split()
RULE_SURNAMES = (
    "Wang Li Zhang Liu Chen Yang Huang Zhao Wu Zhou Xu Sun Ma Zhu Hu Guo Lin He Gao Luo Zheng Liang Xie Tang Han Feng Deng Cao Peng Xiao Jiang Cheng Yuan Lu Pan Ding Wei Ren Shao Qian Kim Lee Park Choi Jung Kang Cho "
    "Yoon Jang Lim Tanaka Suzuki Yamamoto Watanabe Sato Ito Nakamura Smith Johnson Williams Brown Jones Miller Davis Wilson Moore Taylor Anderson Thomas White Harris"
).split()
RULE_NOISE = ["According", "Based", "Given", "Following", "Regarding", "Attention Is", "All You"]
RULE_CONCEPTS = "network model algorithm learning neural transformer".split()
RULE_PATTERNS = [
    ("listed organisation", rf"\b(?:{'|'.join(RULE_ORGANISATIONS)})\b", "ORG", 0.95),
    ("organisation ending", rf"\b[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*\s+(?:{'|'.join(RULE_ENDINGS)})\b", "ORG", 0.85),
    ("listed place", rf"\b(?:{'|'.join(RULE_PLACES)})\b", "LOC", 0.9),
    ("person", rf"(?:{'|'.join(RULE_TITLES)})\s+[A-Z][a-z]+(?:\s+[a-z]+\s+[A-Z][a-z]+|\s+[A-Z][a-z]+)?|[A-Z][a-z]+\s+(?:et\s+al\.?)|[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", "PER", 0.7),
    ("capitalised", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", None, 0.4),
    ("date", rf"\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|(?:{_MONTHS})\s+\d{{1,2}}(?:,\s*\d{{4}})?|\d{{1,2}}\s+(?:{_MONTHS})(?:\s+\d{{4}})?|(?:Q[1-4]|(?:19|20)\d{{2}}))\b", "DATE", 0.8),
    ("money", r"\$[\d,]+\.?\d*\s*(?:billion|million|thousand|B|M|K)?|\d+\.?\d*\s*(?:dollars?|USD|EUR|GBP|billion|million)", "MONEY", 0.8),
    ("percent", r"\d+\.?\d*\s*%", "PERCENT", 0.8),
]
# -----------------------------------------------------------------------------------------------------

_RULES = [(re.compile(p), name, label, sure) for name, p, label, sure in RULE_PATTERNS]
_ARTICLE = re.compile("(?:The|An?) ")
_COMMON = frozenset(w.capitalize() for w in SENTENCE_STARTERS)


def capitalised_label(surface: str) -> str:
    """What a capitalised phrase of no better pattern may be."""
    words = surface.split()
    if len(words) <= 3 and {words[0], words[-1]} & set(RULE_SURNAMES):
        return "PER"
    low = surface.lower()
    return "CONCEPT" if any(c in low for c in RULE_CONCEPTS) else "UNKNOWN"


def rule_spans(text: str, common: Iterable[str] = _COMMON, threshold: float = 0.3) -> list[Found]:
    """Patterns in order; a match that touches a claimed stretch is dropped, a leading article does not count, and a person
    or a capitalised phrase that is a common word or opens like a phrase of prose is none."""
    common, claims, out = set(common), Claims(), []
    for pattern, name, label, sure in _RULES:
        if sure < threshold:
            continue
        for m in pattern.finditer(text):
            article = _ARTICLE.match(m.group())
            start = m.start() + (article.end() if article and name not in ("date", "money", "percent") else 0)
            surface = text[start : m.end()]
            if not surface or not claims.free(m.start(), m.end()):
                continue
            if name in ("person", "capitalised") and (surface in common or surface.startswith(tuple(RULE_NOISE)) or surface.startswith("The ")):
                continue
            claims.add(start, m.end())
            out.append((start, m.end(), surface, label or capitalised_label(surface), name, sure))
    return sorted(out)
