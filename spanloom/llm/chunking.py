"""Problem 3: texts over a size limit, cut at natural boundaries into overlapping pieces under the limit.

Method: content-defined chunking. A rolling hash over the last WINDOW bytes marks landmarks; the first
landmark at least `least` bytes after the last cut is snapped to the nearest natural boundary (paragraph,
line, sentence, word, in this order of preference within reach) that keeps the piece between `least` and
`most`. A cut depends on the bytes near it only, so an edit moves the cuts of neighbouring pieces until the
next shared landmark. The overlap is laid over the finished cuts: a piece starts `overlap` tokens before the
last cut, and `most` leaves room for that, so no piece exceeds the limit.

One token is one byte of UTF-8 (the public byte-level tokenizer). Pieces begin and end between code points;
where code points have several bytes the overlap may be up to 3 bytes longer than asked for, never shorter.
Null texts have no pieces, empty texts one empty piece, texts within the limit one piece. An overlap that leaves no room
under its limit is taken as the largest that does (limit - ROOM); a limit under 4 tokens, which cannot hold every character,
is an error. Where a text repeats itself (equal lines) every place looks alike to the hash, so cuts after an edit need not
come back to where they were; nothing in such a text tells one place from another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 32  # bytes seen by the rolling hash; a power of two
ROOM = 8  # tokens of a piece that its overlap must leave
LANDMARK_EVERY = 8  # landmarks are this many times denser than pieces
_TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Of the WINDOW bytes that end at each position (fewer at the start), by doubling: log2(WINDOW) passes."""
    h = _TABLE[data]
    width = 1
    while width < WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint64(width)
        h = h + shifted if width < len(h) else h
        width *= 2
    return h


def boundaries(data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Cut positions by kind, best first: behind a blank line, a line, a sentence, a word; and all code points."""
    n = len(data)
    newline, space = data == 10, (data == 32) | (data == 9)
    before = np.zeros(n, bool)
    before[1:] = newline[:-1]
    line = np.flatnonzero(newline) + 1
    paragraph = np.flatnonzero(newline & before) + 1
    stop = (data == 46) | (data == 33) | (data == 63)
    after_stop = np.zeros(n, bool)
    after_stop[1:] = stop[:-1]
    latin = np.flatnonzero(after_stop & (space | newline)) + 1
    # the last byte of the ideographic stops: U+3002 is E3 80 82, U+FF01 EF BC 81, U+FF1F EF BC 9F; Arabic U+061F D8 9F
    wide = np.zeros(n, bool)
    if n > 2:
        wide[2:] = ((data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] == 0x82)) | ((data[:-2] == 0xEF) & (data[1:-1] == 0xBC) & ((data[2:] == 0x81) | (data[2:] == 0x9F)))
        wide[1:] |= (data[:-1] == 0xD8) & (data[1:] == 0x9F)
    sentence = np.union1d(latin, np.flatnonzero(wide) + 1)
    word = np.flatnonzero(space | newline) + 1
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    return [paragraph, line, sentence, word], starts


def _nearest(kind: np.ndarray, at: int, low: int, high: int, reach: int) -> int:
    """The member of `kind` nearest to `at` in [low, high] and within reach, or -1."""
    k = np.searchsorted(kind, at)
    best = -1
    for j in (k - 1, k):
        if 0 <= j < len(kind) and low <= kind[j] <= high and abs(kind[j] - at) <= reach and (best < 0 or abs(kind[j] - at) < abs(best - at)):
            best = int(kind[j])
    return best


def _floor(starts: np.ndarray, at: int) -> int:
    return int(starts[np.searchsorted(starts, at, side="right") - 1])


class Cutter:
    """The cuts of one text, for any number of limits."""

    def __init__(self, text: str):
        raw = text.encode("utf-8", "surrogatepass")
        self.data = np.frombuffer(raw, np.uint8)
        self.hash = rolling_hash(self.data)
        self.kinds, self.starts = boundaries(self.data)

    def cuts(self, limit: int, overlap: int) -> list[int]:
        """Byte positions of the inner cuts."""
        n = len(self.data)
        if n <= limit:
            return []
        if limit < 4:
            raise ValueError(f"a limit of {limit} cannot hold every character")
        overlap = max(0, min(overlap, limit - ROOM))
        most_first, most = limit, max(4, limit - overlap - 3)
        mask = np.uint64((1 << max(0, int(limit / LANDMARK_EVERY).bit_length() - 1)) - 1)
        marks = np.flatnonzero((self.hash >> np.uint64(20)) & mask == 0) + 1
        out, at = [], 0
        while n - at > (most_first if not out else most):
            top = at + (most_first if not out else most)
            low = at + max(1, (top - at) * 5 // 8)
            k = np.searchsorted(marks, low + (top - low) // 3)
            mark = int(marks[k]) if k < len(marks) and marks[k] <= top else top
            cut = -1
            for kind, reach in zip(self.kinds, (limit // 8, limit // 8, limit // 4, limit)):
                cut = _nearest(kind, mark, low, top, reach)
                if cut > 0:
                    break
            if cut < 0:
                cut = _floor(self.starts, mark)
                cut = cut if cut > at else _floor(self.starts, top)
            out.append(cut)
            at = cut
        return out

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int]]:
        """(start, end) in bytes."""
        ends = [*self.cuts(limit, overlap), len(self.data)]
        overlap = max(0, min(overlap, limit - ROOM))
        return [(0 if k == 0 else _floor(self.starts, max(0, ends[k - 1] - overlap)), e) for k, e in enumerate(ends)]

    def chars(self, at: int) -> int:
        """Code points before a byte position."""
        return int(np.searchsorted(self.starts, at, side="left"))


PIECES = "config_id int, doc_id bigint, piece_no int, n_pieces int, start_char int, end_char int, n_tokens int"


def split_documents(documents: DataFrame, configs: DataFrame, with_text: bool = True) -> DataFrame:
    """(config_id, doc_id, piece_no, n_pieces, start_char, end_char, n_tokens[, piece_text]) for every
    configuration and document with a text.

    Sizes are compared in the JVM; a text reaches Python once, with all the limits that it exceeds. There is
    no shuffle: the configurations (a small, fixed table, collected below 10,000 rows or refused) travel with the plan."""
    rows = configs.select("config_id", "max_position_embeddings", F.coalesce("overlap_tokens", F.lit(0)).alias("o")).where(F.col("max_position_embeddings").isNotNull()).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("split_documents takes at most 10,000 configurations")
    limits = [(int(r[0]), int(r[1]), int(r[2])) for r in rows]
    spark = documents.sparkSession
    d = documents.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("__size", F.octet_length("text"))
    schema = PIECES + (", piece_text string" if with_text else "")
    if not limits:
        return spark.createDataFrame([], schema)
    small = (
        d.select("*", F.explode(F.array(*[F.struct(F.lit(c).alias("config_id"), F.lit(m).alias("m")) for c, m, _ in limits])).alias("x"))
        .where(F.col("__size") <= F.col("x.m"))
        .select("x.config_id", "doc_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), F.length("text").alias("end_char"), F.col("__size").alias("n_tokens"), *([F.col("text").alias("piece_text")] if with_text else []))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text, size in zip(b["doc_id"], b["text"], b["__size"]):
                cutter = Cutter(text)
                for c, m, o in limits:
                    if size > m:
                        pieces = cutter.pieces(m, o)
                        for k, (s, e) in enumerate(pieces):
                            cs, ce = cutter.chars(s), cutter.chars(e)
                            out.append((c, doc_id, k + 1, len(pieces), cs, ce, e - s) + ((text[cs:ce],) if with_text else ()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    large = d.where(F.col("__size") > min(m for _, m, _ in limits)).mapInPandas(run, schema)
    return small.unionByName(large)


def oversized(documents: DataFrame, configs: DataFrame) -> DataFrame:
    """(config_id, doc_id) of the documents that come out in more than one piece."""
    return split_documents(documents, configs, with_text=False).where((F.col("piece_no") == 1) & (F.col("n_pieces") > 1)).select("config_id", "doc_id")
