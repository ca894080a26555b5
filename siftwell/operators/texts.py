"""Structure of texts in SQL functions: lines, separators, keys and values, HTML tables, JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = {"commas": ",", "semicolons": ";", "pipes": "|", "tabs": "\t"}
PAIR = r"^\s*([A-Za-z0-9_.\-]+)\s*[:=]\s*(.+?)\s*$"


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def lines_with(name: str, mark: str) -> Column:
    return F.size(F.filter(name, lambda x: F.contains(x, F.lit(mark)))).cast("long")


def text_stats(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, n_lines, n_solid, mean_length, lines with each separator)"""
    parts = df.select(key, lines(F.coalesce(text, F.lit(""))).alias("l"))
    solid = F.filter("l", lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != "")
    parts = parts.select(key, F.size("l").alias("n_lines"), solid.alias("s"))
    total = F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x))
    return parts.select(key, F.col("n_lines").cast("long").alias("n_lines"), F.size("s").cast("long").alias("n_solid"), F.round(F.coalesce(F.try_divide(total, F.size("s")), F.lit(0.0)), 2).alias("mean_length"), *[lines_with("s", mark).alias(name) for name, mark in SEPARATORS.items()])


def delimiter_widths(df: DataFrame, text: str, key: str, most: int = 50) -> DataFrame:
    """(key, delimiter, columns, consistency): the best plain (unquoted) delimiter of the first solid lines; null if none fits."""
    solid = F.slice(F.filter(lines(F.coalesce(text, F.lit(""))), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != ""), 1, most)
    rows = df.select(key, solid.alias("s"))
    marks = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(m).alias("delimiter")) for i, m in enumerate((",", "\t", ";", "|"))]))
    each = rows.select(key, "s", marks.alias("m")).select(key, "m.*", F.explode("s").alias("line"))
    widths = each.select(key, "rank", "delimiter", (F.length("line") - F.length(F.replace("line", F.col("delimiter"), F.lit(""))) + 1).alias("w"))
    counted = widths.groupBy(key, "rank", "delimiter", "w").agg(F.count("*").alias("n"))
    modes = counted.groupBy(key, "rank", "delimiter").agg(F.max(F.struct("n", "w")).alias("top"), F.sum("n").alias("total"))
    share = F.col("top.n") / F.col("total")
    fits = modes.where((F.col("total") >= 2) & (F.col("top.w") >= 2) & (share >= 0.8)).select(key, F.struct((F.col("top.w") * share).alias("score"), (-F.col("rank")).alias("r"), "delimiter", F.col("top.w").cast("long").alias("columns"), share.alias("consistency")).alias("b"))
    return fits.groupBy(key).agg(F.max("b").alias("b")).select(key, "b.delimiter", "b.columns", F.round("b.consistency", 6).alias("consistency"))


def key_values(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, name, value): pairs in lines; the first value of a name counts."""
    rows = df.select(key, F.posexplode(lines(F.coalesce(text, F.lit("")))).alias("pos", "line")).where(F.col("line").rlike(PAIR))
    pairs = rows.select(key, "pos", F.regexp_extract("line", PAIR, 1).alias("name"), F.regexp_extract("line", PAIR, 2).alias("value"))
    return pairs.groupBy(key, "name").agg(F.min_by("value", "pos").alias("value"))


def html_table_count(df: DataFrame, html: str, key: str) -> DataFrame:
    """(key, n_tables, n_bytes): table start tags"""
    return df.select(key, F.coalesce(F.regexp_count(F.lower(F.col(html)), F.lit(r"<table[\s>]")), F.lit(0)).cast("long").alias("n_tables"), F.coalesce(F.octet_length(html), F.lit(0)).cast("long").alias("n_bytes"))


def json_kinds(df: DataFrame, text: str) -> DataFrame:
    """(kind, n): how many texts are JSON of each kind; null kind: none."""
    kind = F.schema_of_variant(F.try_parse_json(F.col(text)))
    named = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null").when(kind == "BIGINT", "int").when(kind.isNotNull(), "float")
    return df.groupBy(named.alias("kind")).agg(F.count("*").alias("n"))


def record_schema(df: DataFrame, text: str) -> DataFrame:
    """(key, kind, n): keys of JSON objects, with the types of their values and how often."""
    rows = df.select(F.from_json(F.col(text), "map<string, variant>").alias("m")).where("m is not null")
    each = rows.select(F.explode("m").alias("key", "value"))
    kind = F.schema_of_variant("value")
    named = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int").when(kind.isNull() | (kind == "VOID"), "null").otherwise("float")
    return each.groupBy("key", named.alias("kind")).agg(F.count("*").alias("n"))
