"""Problem 2: a language, with a confidence, for each document and each stretch in another language.

Method: sparse multinomial logistic regression on TF-IDF character n-grams (one to three characters, hashed),
trained with follow-the-regularised-leader and elastic-net penalties, then temperature-calibrated on held-out
sentences. The classifier is fitted on about TRAIN_DOCUMENTS labelled documents (a hash sample,
plus the short seed sentences below, so that each language is known at any size). As labels may be
wrong, a document is learned from only if a model fitted on other documents agrees with its label on the whole.
Document frequencies are counted over all documents.

A document is read sentence by sentence. A sentence counts as whole if it ends like one and has letters
enough; only whole sentences can give a document a language. Shorter pieces take the language around them.

A sentence whose letters are mostly of a script that none of LANGUAGES writes (Hangul, Hebrew, Devanagari, Thai, ...) has no
language here: it gives none to its document and breaks no stretch. A language of a known script that the classifier has not
learned is taken for the nearest one, with the confidence that it gets.

Null and empty texts have no language and no segments. Ties go to the language named first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 17
BINS = 1 << BITS
TRAIN_DOCUMENTS = 5000
MAX_SENTENCES_PER_LANGUAGE = 12_000
EPOCHS, BATCH = 2, 128
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.02, 0.0005
MAX_IDF = 2.5
MIN_CONFIDENCE = 0.75  # for a second language of a document
MIN_LETTERS, MIN_IDEOGRAPHS = 14, 6

# ISO 639-1 code, ISO 639-2 codes, English name.
LANGUAGES = {
    "ar": "ara arabic",
    "de": "deu ger german",
    "el": "ell gre greek",
    "en": "eng english",
    "es": "spa spanish",
    "fr": "fra fre french",
    "it": "ita italian",
    "ja": "jpn japanese",
    "nl": "nld dut dutch",
    "pt": "por portuguese",
    "ru": "rus russian",
    "uk": "ukr ukrainian",
    "zh": "zho chi chinese",
}
CODES = list(LANGUAGES)
_NOTATION = {w: c for c, ws in LANGUAGES.items() for w in [c, *ws.split()]}

SEEDS = {
    "ar": "هذا البيت كبير وله باب أزرق. ذهبنا إلى السوق في الصباح ثم عدنا. لا أعرف متى يصل القطار إلى المدينة.",
    "de": "Das Haus ist groß und hat eine blaue Tür. Wir gingen am Morgen auf den Markt und kamen dann zurück. Ich weiß nicht, wann der Zug in der Stadt ankommt.",
    "el": "Το σπίτι είναι μεγάλο και έχει μπλε πόρτα. Πήγαμε το πρωί στην αγορά και μετά γυρίσαμε. Δεν ξέρω πότε φτάνει το τρένο στην πόλη.",
    "en": "The house is large and has a blue door. We went to the market in the morning and then came back. I do not know when the train arrives in the city.",
    "es": "La casa es grande y tiene una puerta azul. Fuimos al mercado por la mañana y luego volvimos. No sé cuándo llega el tren a la ciudad.",
    "fr": "La maison est grande et a une porte bleue. Nous sommes allés au marché le matin, puis nous sommes rentrés. Je ne sais pas quand le train arrive dans la ville.",
    "it": "La casa è grande e ha una porta blu. Siamo andati al mercato la mattina e poi siamo tornati. Non so quando il treno arriva in città.",
    "ja": "この家は大きくて青い扉があります。私たちは朝に市場へ行って、それから帰りました。列車がいつ町に着くのか分かりません。",
    "nl": "Het huis is groot en heeft een blauwe deur. We gingen in de ochtend naar de markt en kwamen daarna terug. Ik weet niet wanneer de trein in de stad aankomt.",
    "pt": "A casa é grande e tem uma porta azul. Fomos ao mercado de manhã e depois voltamos. Não sei quando o comboio chega à cidade.",
    "ru": "Этот дом большой и у него синяя дверь. Утром мы пошли на рынок, а потом вернулись. Я не знаю, когда поезд приедет в город.",
    "uk": "Цей будинок великий і має сині двері. Вранці ми пішли на ринок, а потім повернулися. Я не знаю, коли потяг приїде до міста.",
    "zh": "这座房子很大，有一扇蓝色的门。我们早上去了市场，然后回来了。我不知道火车什么时候到达城市。",
}


def label_code(label: str | None) -> str | None:
    """The ISO 639-1 code that a label names, in whatever notation, if it is one of LANGUAGES."""
    if not label:
        return None
    word = re.split(r"[-_ .;(]", label.strip().lower())[0]
    return _NOTATION.get(word)


# --- sentences ------------------------------------------------------------------------------------

_CLOSERS = re.escape("\"'”’»)]】」』")
_END = re.compile(rf"(?:[.!?…؟]+[{_CLOSERS}]*(?=\s|$))|[。！？]+[{_CLOSERS}]*|\n+")
_SHORT = re.compile(r"(?:^|[\s(])(?:[^\W\d_]|vol|pp|cf|approx|no|nr|dr|prof|st|mr|mrs|ms|mx|dept|univ|inst|inc|ltd|co|corp|auth|natl|intl|bros|mfg|hosp|grp|assn|lab|res|i\.e|e\.g|p\.m|a\.m)$", re.I)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of consecutive sentences that cover the text. Line breaks end sentences, a full stop does
    unless it follows an abbreviation or a small letter follows it."""
    out, at = [], 0
    for m in _END.finditer(text):
        end = m.end()
        if m.group()[0] == ".":
            after = text[end : end + 40].lstrip()
            if after and (after[0].islower() or _SHORT.search(text[max(at, m.start() - 8) : m.start()])):
                continue
        if text[at:end].strip():
            out.append((at, end))
            at = end
    if text[at:].strip():
        out.append((at, len(text)))
    elif out and at < len(text):
        out[-1] = (out[-1][0], len(text))
    return out


_TERMINAL = re.compile(rf"[.!?…؟。！？][{_CLOSERS}\s]*$")
_IDEOGRAPH = re.compile("[぀-ヿ㐀-鿿]")
_BLOB = re.compile("[A-Za-z0-9+/=]{60,}")  # encoded data, sequences
_WORD = re.compile(r"[^\W\d_]{2,}")


# Letters of scripts in which none of LANGUAGES is written.
_FOREIGN = re.compile("[\u0530-\u05ff\u0700-\u074f\u0780-\u10ff\u1100-\u11ff\u1200-\u137f\u1780-\u17ff\u1800-\u18af\uac00-\ud7a3]")


def is_foreign(sentence: str) -> bool:
    """Whether most letters are of a script that none of LANGUAGES writes."""
    n = len(_FOREIGN.findall(sentence))
    return n > 0 and 2 * n > sum(c.isalpha() for c in sentence)


def is_whole(sentence: str) -> bool:
    """Whether a piece of text reads as a sentence: it ends like one and has letters enough, in some words, of known scripts."""
    if not _TERMINAL.search(sentence) or _BLOB.search(sentence) or is_foreign(sentence):
        return False
    if len(_IDEOGRAPH.findall(sentence)) >= MIN_IDEOGRAPHS:
        return True
    words = _WORD.findall(sentence)
    return len(words) >= 3 and sum(map(len, words)) >= MIN_LETTERS


# --- features -------------------------------------------------------------------------------------


def _tables() -> np.ndarray:
    fold = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return fold


_FOLD = _tables()


def features(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bin, piece) of each n-gram occurrence. Letters are lower-cased, all else is one space."""
    sizes = np.fromiter((len(p) + 2 for p in pieces), np.int64, len(pieces))
    codes = np.frombuffer(" ".join(f" {p} " for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)[: len(codes)]
    x = _FOLD[np.minimum(codes, 0xFFFF)]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (owner[1:] != owner[:-1])
    x, owner = x[keep].astype(np.uint64), owner[keep]
    bins, owners = [], []
    h = np.zeros(len(x), np.uint64)
    for n in (1, 2, 3):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :] if n > 1 else x.copy()
        mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        same = owner[: len(x) - n + 1] == owner[n - 1 :]
        if n == 1:
            same &= x != 32
        bins.append((mixed >> np.uint64(64 - BITS)).astype(np.int64)[same])
        owners.append(owner[: len(x) - n + 1][same])
    return np.concatenate(bins) if bins else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


def document_frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bin occurs, over all of them; at most BINS rows come back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(BINS, np.int64)
        n = 0
        for b in batches:
            texts = b["text"].tolist()
            for k in range(0, len(texts), 64):
                part = texts[k : k + 64]
                h, owner = features(part)
                df += np.bincount(np.unique((owner << BITS) | h) & (BINS - 1), minlength=BINS)
                n += len(part)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bin": np.append(at, -1), "df": np.append(df[at], n)})

    rows = documents.select("text").where(F.col("text").isNotNull()).mapInPandas(count, "bin int, df bigint").groupBy("bin").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BINS, np.int64)
    inner = rows[rows["bin"] >= 0]
    df[inner["bin"].to_numpy()] = inner["df"].to_numpy()
    return df, int(rows.loc[rows["bin"] == -1, "df"].sum())


class Occurrences:
    """The n-gram occurrences of pieces, piece by piece."""

    def __init__(self, pieces: list[str]):
        h, owner = features(pieces)
        order = np.argsort(owner, kind="stable")
        self.bins = h[order].astype(np.int32)
        self.start = np.searchsorted(owner[order], np.arange(len(pieces) + 1))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, place in `which`) of the chosen pieces."""
        n = self.start[which + 1] - self.start[which]
        owner = np.repeat(np.arange(len(which)), n)
        if len(which) and which[-1] - which[0] == len(which) - 1 and (np.diff(which) == 1).all():  # neighbours: no need to gather
            return self.bins[self.start[which[0]] : self.start[which[-1] + 1]], owner
        at = np.repeat(self.start[which] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return self.bins[at], owner


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their owner, owners in order."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(owner):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


class Model:
    """Weights, inverse document frequencies, and the temperature."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf.astype(np.float32)
        self.weights = np.zeros((BINS, len(CODES)), np.float32)
        self.temperature = 1.0
        self._scaled: tuple[np.ndarray, np.ndarray] | None = None

    def values(self, bins: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """The TF-IDF weight of each occurrence, of unit length in each piece."""
        v = self.idf[bins]
        norm = np.sqrt(np.bincount(owner, v * v, n)) + 1e-9
        return v / norm[owner].astype(np.float32)

    def probabilities(self, pieces: list[str] | Occurrences, which: np.ndarray | None = None) -> np.ndarray:
        found = pieces if isinstance(pieces, Occurrences) else Occurrences(pieces) if pieces else None
        if which is None:
            which = np.arange(len(pieces) if isinstance(pieces, list) else len(found.start) - 1)
        out = np.zeros((len(which), len(CODES)), np.float32)
        # The weight of an occurrence is its inverse document frequency over the length of its piece: the first is put into the
        # table once, the second divides the sums, so that the wide array is only gathered and added up.
        if self._scaled is None or self._scaled[0] is not self.weights:
            self._scaled = (self.weights, self.weights * self.idf[:, None])
        scaled, squares = self._scaled[1], self.idf * self.idf
        for k in range(0, len(which), 512):
            part = which[k : k + 512]
            bins, owner = found.take(part)
            norm = np.sqrt(np.bincount(owner, squares[bins], len(part))) + 1e-9
            out[k : k + 512] = _sums(scaled[bins], owner, len(part)) / norm[:, None]
        return softmax(out / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf))
    return e / e.sum(axis=1, keepdims=True)


def train(found: Occurrences, which: np.ndarray, labels: np.ndarray, idf: np.ndarray, epochs: int, seed: int = 1) -> Model:
    """Follow-the-regularised-leader (proximal), by small batches, over the pieces `which`."""
    model, k = Model(idf), len(CODES)
    z, squares = np.zeros((BINS, k), np.float32), np.zeros((BINS, k), np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(which)
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            bins, owner = found.take(part)
            if not len(bins):
                continue
            v = model.values(bins, owner, len(part))[:, None]
            used, inverse = np.unique(bins, return_inverse=True)
            w = _weights(z[used], squares[used])
            p = softmax(_sums(w[inverse] * v, owner, len(part)))
            p[np.arange(len(part)), labels[part]] -= 1
            by_bin = np.argsort(inverse, kind="stable")
            g = _sums((p[owner] * v)[by_bin], inverse[by_bin], len(used))
            new = squares[used] + g * g
            z[used] += g - (np.sqrt(new) - np.sqrt(squares[used])) / ALPHA * w
            squares[used] = new
    model.weights = _weights(z, squares)
    return model


def _weights(z: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(squares)) / ALPHA + L2)).astype(np.float32)


def calibrate(model: Model, found: Occurrences, which: np.ndarray, labels: np.ndarray) -> None:
    """The temperature of least cross-entropy on held-out sentences."""
    if not len(which):
        return
    s = np.log(model.probabilities(found, which) + 1e-20)
    grid = np.geomspace(0.1, 4, 60)
    loss = [-np.log(softmax(s / t)[np.arange(len(which)), labels[which]] + 1e-9).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])


def fit(documents: DataFrame) -> Model:
    """The classifier for these documents; the driver holds about TRAIN_DOCUMENTS texts, twice as many at most."""
    df, n = document_frequencies(documents)
    idf = np.minimum(np.log((1.0 + n) / (1.0 + df)) + 1.0, MAX_IDF)  # rare n-grams come from names
    labelled = documents.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.lower(F.split(F.trim("lang"), "[-_ .;(]")[0]).isin(list(_NOTATION)))
    # a hash sample of the wanted share: no task sorts or gathers more than its own part of it
    labelled = labelled.withColumn("__h", F.xxhash64("doc_id", F.lit(3)))
    share = F.pmod("__h", F.lit(1 << 20))
    wanted = (1 << 20) * min(1.0, TRAIN_DOCUMENTS / max(1, labelled.count()))
    # Of a share of that size more than twice the wanted number never come; the first by hash would be taken, part by part.
    sample = labelled.where(share < F.lit(int(np.ceil(wanted)))).orderBy(share, "__h", "doc_id").limit(2 * TRAIN_DOCUMENTS)
    rows = sorted(sample.collect(), key=lambda r: (r["__h"], r.doc_id))
    pieces, labels, fold, doc = [], [], [], []
    count: dict[str, int] = {}
    for c, text in SEEDS.items():
        for a, b in sentences(text):
            pieces += [text[a:b]] * 4
            labels += [CODES.index(c)] * 4
            fold += [-1] * 4
            doc += [-1] * 4
    for k, r in enumerate(rows):
        c = label_code(r.lang)
        for a, b in sentences(r.text):
            if c and is_whole(r.text[a:b]) and count.get(c, 0) < MAX_SENTENCES_PER_LANGUAGE:
                count[c] = count.get(c, 0) + 1
                pieces.append(r.text[a:b].strip())
                labels.append(CODES.index(c))
                fold.append(k % 4)
                doc.append(k)
    y, part = np.array(labels), np.array(fold)
    found = Occurrences(pieces)
    # Labels may be wrong: a document stays only if a model that has not seen it agrees with its label on the
    # whole, and of such a document those sentences that it does not take for another language.
    agree, owner = part < 0, np.array(doc)
    for mine in ((0, 1), (2, 3)):
        inside = np.isin(part, mine)
        other = train(found, np.flatnonzero(~inside), y, idf, EPOCHS)
        at = np.flatnonzero(inside)
        p = other.probabilities(found, at)
        whole = np.zeros((len(rows), len(CODES)))
        np.add.at(whole, owner[at], np.log(p + 0.01))
        agree[at] = (whole.argmax(axis=1)[owner[at]] == y[at]) & (p[np.arange(len(at)), y[at]] >= 0.25)
    model = train(found, np.flatnonzero(agree & (part != 3)), y, idf, EPOCHS)
    calibrate(model, found, np.flatnonzero(agree & (part == 3)), y)
    return model


# --- documents ------------------------------------------------------------------------------------

SEGMENTS = T.ArrayType(
    T.StructType([
        T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("lang_code", T.StringType()),
        T.StructField("confidence", T.DoubleType()), T.StructField("n_whole", T.IntegerType()),
    ])
)


def segment_texts(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, str, float, int]]]:
    """Per text: consecutive stretches in one language, with the mean confidence and the number of whole sentences."""
    spans = [sentences(t) if t else [] for t in texts]
    pieces = [t[a:b] for t, s in zip(texts, spans) for a, b in s]
    p = model.probabilities(pieces)
    best, sure = p.argmax(axis=1), p.max(axis=1) if len(p) else np.zeros(0)
    whole = [is_whole(x) for x in pieces]
    out, at = [], 0
    for t, s in zip(texts, spans):
        own = range(at, at + len(s))
        at += len(s)
        votes = np.zeros(len(CODES))
        for k in own:
            votes += p[k] * len(pieces[k]) * (1.0 if whole[k] else 0.02)
        main = int(votes.argmax()) if len(s) else -1
        lang: list[int] = []
        for k in own:
            if whole[k] and (best[k] == main or sure[k] >= MIN_CONFIDENCE):
                lang.append(int(best[k]))
            else:
                lang.append(-1)
        segments: list[list] = []
        before = main
        for (a, b), k, g in zip(s, own, lang):
            code = before if g < 0 else g
            if segments and segments[-1][2] == code:
                x = segments[-1]
                x[1], x[3], x[4] = b, x[3] + float(p[k][code]) * (b - a), x[4] + (g >= 0)
            else:
                segments.append([a, b, code, float(p[k][code]) * (b - a), int(g >= 0)])
            before = code
        out.append([(a, b, CODES[c], round(w / max(1, b - a), 4), n) for a, b, c, w, n in segments])
    return out


def identified(documents: DataFrame, model: Model | None = None, with_null: bool = False) -> DataFrame:
    """(doc_id, lang, segments): every document with a text, or every document (a null text has no segments). No shuffle: each
    text is read where it lies.

    The model (its size is bounded by BINS times the number of languages) is broadcast."""
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast((model.idf, model.weights, model.temperature))

    @F.pandas_udf(SEGMENTS)
    def segments(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(shared.value[0])
        m.weights, m.temperature = shared.value[1], shared.value[2]
        for texts in batches:
            values = texts.tolist()
            found: list = []
            for k in range(0, len(values), 256):
                found += segment_texts(m, values[k : k + 256])
            yield pd.Series(found)

    d = documents if with_null else documents.where(F.col("text").isNotNull())
    return d.select("doc_id", "lang", segments("text").alias("segments"))


def language_segments(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, segment_no, start_char, end_char, lang_code, confidence)"""
    s = identified(documents, model).select("doc_id", F.posexplode("segments").alias("segment_no", "s"))
    return s.select("doc_id", (F.col("segment_no") + 1).alias("segment_no"), "s.start_char", "s.end_char", "s.lang_code", "s.confidence")


def document_languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang_code, confidence, languages): the language of most text, and all of whole sentences.
    Documents without text have null for all."""
    d = identified(documents, model, with_null=True).select("doc_id", "segments")
    length = lambda c: F.aggregate(F.filter("segments", lambda x: x["lang_code"] == c), F.lit(0), lambda a, x: a + x["end_char"] - x["start_char"])
    codes = F.array_distinct(F.transform("segments", lambda x: x["lang_code"]))
    main = F.array_max(F.transform(codes, lambda c: F.struct(length(c).alias("n"), c.alias("c"))))["c"]
    weighted = F.aggregate(F.filter("segments", lambda x: x["lang_code"] == F.col("lang_code")), F.lit(0.0), lambda a, x: a + x["confidence"] * (x["end_char"] - x["start_char"]))
    d = d.withColumn("lang_code", main)
    languages = F.when(F.col("lang_code").isNotNull(), _whole_languages())
    return d.select("doc_id", "lang_code", F.try_divide(weighted, length(F.col("lang_code"))).alias("confidence"), languages.alias("languages"))


def _whole_languages():
    return F.array_sort(F.array_distinct(F.transform(F.filter("segments", lambda x: x["n_whole"] > 0), lambda x: x["lang_code"])))


def mislabelled(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang_code): the languages of documents whose label is missing or wrong, or that mix languages."""
    named = F.create_map(*[F.lit(x) for w, c in _NOTATION.items() for x in (w, c)])[F.lower(F.split(F.trim("lang"), "[-_ .;(]")[0])]
    d = identified(documents, model).select("doc_id", named.alias("named"), _whole_languages().alias("languages"))
    case = (F.size("languages") > 1) | ((F.size("languages") == 1) & ~F.coalesce(F.col("named") == F.col("languages")[0], F.lit(False)))
    return d.where(case).select("doc_id", F.explode("languages").alias("lang_code"))
