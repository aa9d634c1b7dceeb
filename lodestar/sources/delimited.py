"""Delimited files: COPY and LOAD DATA semantics on Spark's CSV source."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed(value: Column, kind: T.DataType) -> Column:
    """Text to a column's type: empty or NULL text is NULL, words for booleans, NULL for what doesn't fit."""
    text = F.when((F.trim(value) == "") | (F.upper(F.trim(value)) == "NULL"), None).otherwise(value)
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(F.trim(text)).isin("true", "t", "yes", "y", "1", "on"), True).when(text.isNotNull(), False)
    return F.trim(text).try_cast(kind)


def read(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, delimiter: str = ",", quote: str = '"', null: str = "", encoding: str = "UTF-8") -> DataFrame:
    """Every column is read as text (one pass, no inference) and cast by the schema."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.csv(path, schema=text, header=header, sep=delimiter, quote=quote, nullValue=null, encoding=encoding, multiLine=False, enforceSchema=True)
    return raw.select(*(typed(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields))


def write(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", quote: str = '"', null: str = "", encoding: str = "UTF-8") -> None:
    df.write.mode("overwrite").csv(path, header=header, sep=delimiter, quote=quote, nullValue=null, encoding=encoding)


_OPTION = re.compile(r"(\w+)\s*(?:=\s*)?('(?:[^']|'')*'|\w+)?\s*(?:,|$)")


def copy_options(text: str) -> dict:
    """The WITH (...) list of COPY."""
    out: dict = {}
    for name, raw in _OPTION.findall(text):
        value = raw.strip("'").replace("\\t", "\t") if raw else "true"
        key = name.lower()
        if key == "header":
            out["header"] = value.lower() in ("true", "1", "on", "yes")
        elif key in ("delimiter", "quote", "null", "encoding"):
            out[key] = value
        elif key != "format":
            raise ValueError(f"unknown option {name}")
    return out


def load_data(spark: SparkSession, path: str, schema: T.StructType, clauses: str) -> DataFrame:
    """LOAD DATA ... FIELDS TERMINATED BY / ENCLOSED BY, LINES TERMINATED BY, IGNORE n ROWS, (columns)."""
    find = lambda pattern, default: (m[1].encode().decode("unicode_escape") if (m := re.search(pattern, clauses, re.I)) else default)
    sep = find(r"FIELDS\s+TERMINATED\s+BY\s+'([^']*)'", "\t")
    quote = find(r"ENCLOSED\s+BY\s+'([^']*)'", '"')
    line = find(r"LINES\s+TERMINATED\s+BY\s+'([^']*)'", "\n")
    skip = int(m[1]) if (m := re.search(r"IGNORE\s+(\d+)\s+(?:ROWS|LINES)", clauses, re.I)) else 0
    columns = [c.strip() for c in m[1].split(",")] if (m := re.search(r"\(([^()]*)\)\s*$", clauses)) else schema.names
    fields = [schema[c] for c in columns]
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
    lines = spark.read.text(path, lineSep=line)
    if skip:  # the first lines of each file, by their place in it
        at = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
        heads = at.where("block = 0").groupBy("file").agg(F.min("n").alias("first"))
        lines = at.join(heads, "file", "left").where((F.col("block") > 0) | (F.col("n") >= F.col("first") + skip)).select("value")
    parsed = lines.where("value <> ''").select(F.from_csv("value", text.simpleString()[7:-1].replace(":", " "), {"sep": sep, "quote": quote, "nullValue": "\\N"}).alias("r"))
    return parsed.select(*(typed(F.col(f"r.{f.name}"), f.dataType).alias(f.name) for f in fields))


def to_format(df: DataFrame, kind: str) -> DataFrame:
    """Rows as lines of json, tsv or csv."""
    if kind == "json":
        return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return df.select(F.to_csv(F.struct(*df.columns), {"sep": "\t" if kind == "tsv" else ","}).alias("value"))
