"""Readers of annotated and plain text inputs. Every reader is lazy and distributed; offsets are characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

ENTITY_ARRAY = "array<struct<text:string,label:string,start:int,end:int,confidence:double>>"


def text_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md"), recursive: bool = True) -> DataFrame:
    """(doc_id, text): a file each, its path as id."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    return r.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def jsonl_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of objects with an optional id; a line without text is an error when it is read."""
    r = spark.read.schema("id string, text string").json(path)
    line = F.concat(F.lit("line:"), F.monotonically_increasing_id().cast("string"))
    checked = F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.lit("a line has no text")).cast("string"))
    return r.select(F.coalesce("id", line).alias("doc_id"), checked.alias("text"))


def entity_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """(doc_id, text, label, start, end, confidence, valid): entities of objects {text, entities}; valid tells whether the
    offsets hold the entity's text."""
    r = spark.read.option("multiLine", str(not lines).lower()).schema(f"id string, text string, entities {ENTITY_ARRAY}").json(path)
    r = r.withColumn("doc_id", F.coalesce("id", F.md5("text"))).select("doc_id", F.col("text").alias("doc"), F.explode_outer("entities").alias("e"))
    good = (F.col("e.start") >= 0) & (F.col("e.start") < F.col("e.end")) & (F.substring("doc", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")) == F.col("e.text"))
    return r.where("e IS NOT NULL").select("doc_id", "e.*", F.coalesce(good, F.lit(False)).alias("valid"))


def conll_tokens(lines: DataFrame, file: str = "file", line_no: str = "line_no", value: str = "value") -> DataFrame:
    """(file, sentence, pos, token, tag) of CoNLL lines (file, line_no, value): a blank line ends a sentence, document
    marks are skipped; the tag is the fourth column, or the last of fewer, or O."""
    w = Window.partitionBy(file).orderBy(line_no)
    x = lines.withColumn("__blank", (F.trim(value) == "").cast("int")).withColumn("sentence", F.sum("__blank").over(w))
    x = x.where((F.col("__blank") == 0) & ~F.col(value).startswith("-DOCSTART-")).withColumn("c", F.split(F.trim(value), r"\s+"))
    tag = F.when(F.size("c") >= 4, F.get("c", F.lit(3))).when(F.size("c") >= 2, F.element_at("c", -1)).otherwise(F.lit("O"))
    pos = F.row_number().over(Window.partitionBy(file, "sentence").orderBy(line_no)) - 1
    return x.select(file, "sentence", pos.alias("pos"), F.get("c", F.lit(0)).alias("token"), tag.alias("tag"))


def conll_file(spark: SparkSession, path: str) -> DataFrame:
    """CoNLL files, each read as one and parted into numbered lines."""
    r = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return conll_tokens(r)


def tag_jsonl(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(seq, pos, token, tag) of objects {tokens, ner_tags} with tags as places in `names`; malformed lines are skipped."""
    r = spark.read.schema("tokens array<string>, ner_tags array<int>").option("mode", "DROPMALFORMED").json(path)
    r = r.where("tokens IS NOT NULL AND ner_tags IS NOT NULL").withColumn("seq", F.monotonically_increasing_id())
    r = r.select("seq", F.posexplode(F.arrays_zip("tokens", "ner_tags")).alias("pos", "x"))
    tag = F.coalesce(F.get(F.array(*map(F.lit, names)), F.col("x.ner_tags")), F.lit("O"))
    return r.select("seq", "pos", F.col("x.tokens").alias("token"), tag.alias("tag")).where("token IS NOT NULL")


def tag_word_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(token, tag) of lines `TAG<tab>word`."""
    c = F.split(value, "\t")
    return lines.where(F.size(c) == 2).select(F.get(c, F.lit(1)).alias("token"), F.get(c, F.lit(0)).alias("tag"))


def gap_rows(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, pronoun, pronoun_offset, a, a_offset, a_coref, b, b_offset, b_coref) of tab-separated pronoun rows; rows
    of fewer columns are skipped."""
    names = "id text pronoun pronoun_offset a a_offset a_coref b b_offset b_coref".split()
    kinds = {"pronoun_offset": "int", "a_offset": "int", "b_offset": "int", "a_coref": "boolean", "b_coref": "boolean"}
    r = spark.read.option("sep", "\t").option("header", "true").option("mode", "PERMISSIVE").option("quote", "").csv(path)
    r = r.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(r.columns, names)])
    return r.where(F.col("b_coref").isNotNull()).select(*[F.col(n).cast(kinds.get(n, "string")).alias(n) for n in names])


def standoff(lines: DataFrame, value: str = "value") -> DataFrame:
    """(ann_id, label, start, end, text) of stand-off lines `T1<tab>TYPE start end<tab>text`; other lines are skipped."""
    p = r"^(T\d+)\t(\S+) (\d+) (\d+)\t(.*)$"
    g = lambda i: F.regexp_extract(value, p, i)
    return lines.where(F.col(value).rlike(p)).select(g(1).alias("ann_id"), g(2).alias("label"), g(3).cast("int").alias("start"), g(4).cast("int").alias("end"), g(5).alias("text"))


def gold_spec(column: Column) -> Column:
    """A struct(text, label, start, end) of a spec `text:label:start:end`; the text may hold colons."""
    p = r"^(.*):([^:]*):(\d+):(\d+)$"
    return F.when(column.rlike(p), F.struct(F.regexp_extract(column, p, 1).alias("text"), F.regexp_extract(column, p, 2).alias("label"), F.regexp_extract(column, p, 3).cast("int").alias("start"), F.regexp_extract(column, p, 4).cast("int").alias("end")))


def relation_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, head, tail, relation, evidence) of document relation files: sentences, entities with mentions, labels."""
    schema = "title string, sents array<array<string>>, vertexSet array<array<struct<name:string,sent_id:int,pos:array<int>,type:string>>>, labels array<struct<h:int,t:int,r:string,evidence:array<int>>>"
    r = spark.read.schema(schema).json(path).select(F.col("title").alias("doc_id"), "vertexSet", F.explode("labels").alias("l"))
    name = lambda i: F.get(F.get("vertexSet", i), F.lit(0))["name"]
    return r.select("doc_id", name(F.col("l.h")).alias("head"), name(F.col("l.t")).alias("tail"), F.col("l.r").alias("relation"), F.col("l.evidence").alias("evidence"))
