"""Writers and renderers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "jsonl", "parquet", "csv", "text")


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Any result in one of FORMATS; text takes the only string column."""
    if fmt not in FORMATS:
        raise ValueError(f"one of {FORMATS}, not {fmt}")
    w = df.write.mode(mode)
    if fmt in ("json", "jsonl"):
        w.json(path)
    elif fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        getattr(w, fmt)(path)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlighted(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, html): each text with its spans marked; of overlapping spans the first by start, then the longest.

    The spans of one document meet in one array: as many as its text allows."""
    s = spans.where("start_char < end_char").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", (-F.col("end_char")).alias("e"), "label"))).alias("s"))
    empty = "named_struct('at', 0, 'html', '')"
    piece = lambda a, b: f"replace(replace(replace(substring(text, {a} + 1, {b} - {a}), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    step = f"if(x.start_char < acc.at, acc, named_struct('at', -x.e, 'html', concat(acc.html, {piece('acc.at', 'x.start_char')}, '<mark title=\"', coalesce(x.label, ''), '\">', {piece('x.start_char', '(-x.e)')}, '</mark>')))"
    end = f"concat(acc.html, {piece('acc.at', 'length(text)')})"
    j = documents.where("text IS NOT NULL").select("doc_id", "text").join(s, "doc_id", "left")
    return j.select("doc_id", F.expr(f"aggregate(coalesce(s, cast(array() as array<struct<start_char:int,e:int,label:string>>)), {empty}, (acc, x) -> {step}, acc -> {end})").alias("html"))


def tree_lines(spans: DataFrame) -> DataFrame:
    """(line): spans as readable lines."""
    return spans.select(F.format_string("%s  [%s,%s)  %-10s %s", "doc_id", "start_char", "end_char", F.coalesce("label", F.lit("-")), "text").alias("line"))


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; larger ones are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)])
