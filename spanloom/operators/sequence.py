"""Token sequences and tags: decoding, encoding, validation and repair of BIO schemes. Tokens are rows
(seq, pos, token, tag); all operators are windows over a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def tokens_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(seq, pos, token, start_char, end_char): words between blanks, with offsets: the lengths of the words before, summed by a
    window, so a long text costs no more a word than a short one."""
    r = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("seq"), F.posexplode(F.split(text, " ")).alias("pos", "token"))
    w = Window.partitionBy("seq").orderBy("pos")
    end = (F.sum(F.length("token") + 1).over(w) - 1).cast("int")
    r = r.withColumn("end_char", end)
    return r.select("seq", "pos", "token", (F.col("end_char") - F.length("token")).alias("start_char"), "end_char").where("token <> ''")


def tag_spans(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens with a BIO tag from spans (seq, span_start, span_end, label); a later span (by start, then label) overwrites."""
    j = tokens.join(spans, "seq", "left").where(F.col("span_start").isNull() | ((F.col("start_char") < F.col("span_end")) & (F.col("end_char") > F.col("span_start"))))
    hit = j.groupBy("seq", "pos").agg(F.max(F.struct("span_start", "label")).alias("s"))
    t = tokens.join(hit, ["seq", "pos"], "left")
    first = F.lag("s").over(Window.partitionBy("seq").orderBy("pos"))
    return t.withColumn("before", first).select(
        "seq", "pos", "token", "start_char", "end_char",
        F.when(F.col("s.label").isNull(), F.lit("O")).when(F.col("before").eqNullSafe(F.col("s")), F.concat(F.lit("I-"), "s.label")).otherwise(F.concat(F.lit("B-"), "s.label")).alias("tag"),
    )


def bio_to_spans(tokens: DataFrame) -> DataFrame:
    """(seq, first_pos, last_pos, label, surface): islands of tags of any scheme (IOB1, IOB2, IOE1, IOE2, IOBES, BILOU). A B, S or U,
    a change of label, a gap, or an end (E, L, S, U) before it starts a new one; an I without a beginning starts one, too."""
    w = Window.partitionBy("seq").orderBy("pos")
    label = F.when(F.col("tag") != "O", F.regexp_replace("tag", "^[BIESLU]-", ""))
    t = tokens.withColumn("label", label).withColumns({"previous": F.lag("label").over(w), "ended": F.coalesce(F.lag("tag").over(w).rlike("^[ELSU]-"), F.lit(False))})
    start = F.col("label").isNotNull() & (F.col("tag").rlike("^[BSU]-") | F.col("ended") | ~F.col("label").eqNullSafe(F.col("previous")))
    t = t.withColumn("island", F.sum(start.cast("int")).over(w)).where("label IS NOT NULL")
    g = t.groupBy("seq", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("x"))
    return g.select("seq", "first_pos", "last_pos", "label", F.array_join(F.col("x.token"), " ").alias("surface"))


def invalid_tags(tokens: DataFrame) -> DataFrame:
    """(seq, pos, tag): I tags that follow neither B nor I of their label."""
    w = Window.partitionBy("seq").orderBy("pos")
    t = tokens.withColumn("previous", F.lag("tag").over(w))
    ok = F.substring("previous", 3, 1000) == F.substring("tag", 3, 1000)
    return t.where(F.col("tag").startswith("I-") & ~F.coalesce(ok & (F.col("previous") != "O"), F.lit(False))).select("seq", "pos", "tag")


def repair_tags(tokens: DataFrame, promote: bool = True) -> DataFrame:
    """Tags made valid: an I without its beginning becomes B, or with promote=False O. Each decision sees the repaired
    tag before it, so a sequence is folded as one array."""
    g = tokens.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "tag"))).alias("x"))
    fixed = (
        "aggregate(x, cast(array() as array<string>), (acc, t) -> concat(acc, array("
        "case when t.tag like 'I-%' and not coalesce(try_element_at(acc, -1) <> 'O' and substring(try_element_at(acc, -1), 3) = substring(t.tag, 3), false) "
        "then " + ("concat('B-', substring(t.tag, 3))" if promote else "'O'") + " else t.tag end)))"
    )
    g = g.select("seq", F.posexplode(F.arrays_zip(F.col("x"), F.expr(fixed).alias("f"))).alias("i", "y"))
    return g.select("seq", F.col("y.x.pos").alias("pos"), F.col("y.x.token").alias("token"), F.col("y.f").alias("tag"))


def context(tokens: DataFrame, width: int = 3) -> DataFrame:
    """tokens with the words of `width` places before and behind."""
    w = Window.partitionBy("seq").orderBy("pos")
    return tokens.withColumns({
        "before": F.concat_ws(" ", F.collect_list("token").over(w.rowsBetween(-width, -1))),
        "after": F.concat_ws(" ", F.collect_list("token").over(w.rowsBetween(1, width))),
    })
