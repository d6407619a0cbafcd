"""Text functions on columns: cleaning, language by script, similarity, labels, buckets, stems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space by Unicode, as the inside of a character class of Java's regex and of RE2.
SPACE = r" \t\n\x0B\f\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK = SPACE.replace(r"\n", "")
ZERO_WIDTH = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF)))

# Scripts and letters that count for a language, with their weights, in the order that breaks ties.
LANGUAGE_CLASSES = [
    ("en", r"[a-zA-Z]", 1),
    ("de", r"[ßäöüÄÖÜ]", 10),
    ("fr", r"[àâçéèêëîïôûù]", 5),
    ("es", r"[ñáíóú]", 5),
    ("ru", r"[\x{400}-\x{481}\x{48a}-\x{4ff}]", 1),
    ("zh", r"[\x{4e00}-\x{9fff}]", 1),
    ("ja", r"[\x{3041}-\x{3096}\x{309d}-\x{309f}\x{30a1}-\x{30fa}\x{30fc}-\x{30ff}]", 1),
    ("ko", r"[\x{ac00}-\x{d7a3}]", 1),
    ("ar", r"[\x{620}-\x{64a}\x{66e}-\x{6d3}\x{6fa}-\x{6fc}]", 1),
    ("he", r"[\x{5d0}-\x{5ea}]", 1),
]

# Notations of labels.
LABEL_ALIASES = {
    "PER": "PER", "PERSON": "PER", "ORG": "ORG", "ORGANIZATION": "ORG", "COMPANY": "ORG", "LOC": "LOC", "LOCATION": "LOC", "GPE": "LOC",
    "DATE": "DATE", "TIME": "TIME", "MONEY": "MONEY", "PERCENT": "PERCENT", "EMAIL": "EMAIL", "URL": "URL", "URI": "URL", "PHONE": "PHONE",
    "PHONE_NUMBER": "PHONE", "TEL": "PHONE", "QUANTITY": "QUANTITY", "QTY": "QUANTITY", "CARDINAL": "CARDINAL", "ORDINAL": "ORDINAL",
}
CATEGORIES = {
    "PER": "Agent", "ORG": "Organization", "LOC": "Place", "DATE": "Temporal", "TIME": "Temporal", "MONEY": "Numeric", "PERCENT": "Numeric",
    "QUANTITY": "Numeric", "CARDINAL": "Numeric", "ORDINAL": "Numeric", "EMAIL": "Contact", "URL": "Contact", "PHONE": "Contact",
}


def clean_whitespace(c: Column) -> Column:
    """Line ends become \\n; a run of white space becomes one space, or one \\n from its first line break on; ends are trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, rf"\n[{SPACE}]*", "\n")
    c = F.regexp_replace(c, rf"[{BLANK}]+", " ")
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def language_by_script(c: Column) -> Column:
    """The language of most weighted letters; English without letters; Chinese with any kana is Japanese; ties go to the
    first. Each class of letters is counted once: the counts are a lambda's variable, then a place in them is looked up."""
    counts = F.array(*[F.regexp_count(c, F.lit(p)) * w for _, p, w in LANGUAGE_CLASSES])
    codes = F.array(*[F.lit(code) for code, _, _ in LANGUAGE_CLASSES])
    kana = [code for code, _, _ in LANGUAGE_CLASSES].index("ja")

    def choose(n: Column) -> Column:
        code = F.get(codes, F.array_position(n, F.array_max(n)).cast("int") - 1)
        return F.when(F.array_max(n) == 0, F.lit("en")).when((code == "zh") & (n[kana] > 0), F.lit("ja")).otherwise(code)

    return F.when(c.isNotNull(), F.get(F.transform(F.array(counts), choose), F.lit(0))).otherwise(F.lit("en"))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    """Of the sets of words; 0 where both are empty."""
    x, y = word_set(a), word_set(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def string_similarity(a: Column, b: Column) -> Column:
    """1 if equal without case, 0.8 if one holds the other, else the word Jaccard; two empty strings 1, one 0."""
    x, y = F.lower(a), F.lower(b)
    return (
        F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).when(x == y, F.lit(1.0))
        .when(F.contains(x, y) | F.contains(y, x), F.lit(0.8)).otherwise(word_jaccard(x, y))
    )


def resolver_similarity(a: Column, b: Column) -> Column:
    """Word Jaccard that minds case; two empty strings 1, one 0."""
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(word_jaccard(a, b))


def char_ngrams(c: Column, n: int) -> Column:
    """Windows of n characters; a shorter text is its own only one."""
    return F.when(F.length(c) < n, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))


def canonical_label(c: Column) -> Column:
    """B-/I-/E-/S- prefixes go, aliases meet; an unknown label stays in capitals."""
    bare = F.upper(F.regexp_replace(c, r"^[BIESbies]-", ""))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in LABEL_ALIASES.items() for x in kv])[bare], bare)


def label_category(c: Column) -> Column:
    return F.when(c.isNotNull(), F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])[c], F.lit("Misc")))


def char_bucket(n: Column) -> Column:
    return F.when(n <= 5, "VeryShort").when(n <= 15, "Short").when(n <= 30, "Medium").when(n <= 50, "Long").when(n.isNotNull(), "VeryLong")


def word_bucket(n: Column) -> Column:
    return F.when(n <= 1, "SingleWord").when(n == 2, "TwoWords").when(n == 3, "ThreeWords").when(n.isNotNull(), "FourPlusWords")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, rf"[{SPACE}]+"), lambda w: w != ""))


def simple_stem(c: Column) -> Column:
    """A verb's trigger form: -ation, -tion or -sion, -ing, -ed or -s go where a stem of some length stays, then a doubled last letter is single."""
    w = F.lower(c)
    n = F.length(w)
    s = (
        F.when(w.endswith("ation") & (n > 7), F.substring(w, F.lit(1), n - 5))
        .when((w.endswith("tion") | w.endswith("sion")) & (n > 6), F.substring(w, F.lit(1), n - 3))
        .when(w.endswith("ing") & (n > 5), F.substring(w, F.lit(1), n - 3))
        .when(w.endswith("ed") & (n > 4), F.substring(w, F.lit(1), n - 2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )
    m = F.length(s)
    return F.when((m > 2) & (F.substring(s, m, F.lit(1)) == F.substring(s, m - 1, F.lit(1))), F.substring(s, F.lit(1), m - 1)).otherwise(s)


# Words that negate a mention, words that quantify one.
NEGATIONS = "not no never none neither nor without hardly scarcely barely don't doesn't didn't won't wouldn't can't cannot isn't".split()
UNIVERSAL, EXISTENTIAL, NONE, DEFINITE = "every all each any".split(), "some a an".split(), "no none".split(), "the this that these those".split()


def words_before(text: Column, start: Column, n: int) -> Column:
    """The last n words before a position, lower case. They are cut from the end of the stretch (read backwards), so what
    stands before them is never split."""
    back = F.reverse(F.substring(text, F.lit(1), start))
    words = F.lower(F.reverse(F.regexp_extract(back, rf"^[{SPACE}]*((?:[^{SPACE}]+[{SPACE}]+){{0,{n - 1}}}[^{SPACE}]+)", 1)))
    return F.filter(F.split(words, rf"[{SPACE}]+"), lambda x: x != "")


def is_negated(text: Column, start: Column) -> Column:
    return F.arrays_overlap(words_before(text, start, 3), F.array(*map(F.lit, NEGATIONS)))


def quantifier(text: Column, start: Column) -> Column:
    w = F.get(words_before(text, start, 1), F.lit(0))
    return F.when(w.isin(UNIVERSAL), "Universal").when(w.isin(EXISTENTIAL), "Existential").when(w.isin(NONE), "None").when(w.isin(DEFINITE), "Definite")


def html_to_text(c: Column) -> Column:
    """Scripts and styles go with their bodies, tags go (block tags leave a space), entities are read, lines trimmed, blank ones dropped."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?is)<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?i)<(?:p|div|br|li|h[1-6])\b[^>]*>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for name, ch in ENTITIES:
        c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


# Named entities, the ampersand last.
ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("#39", "'"), ("nbsp", " "), ("mdash", "—"), ("ndash", "–"), ("hellip", "…"), ("copy", "©"), ("amp", "&")]
