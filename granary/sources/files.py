"""Files: delimited text, question-and-answer templates, raw bytes and storage keys."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import similar_questions, strip, tags_of

ENCODINGS = ("utf-8", "gb18030", "gb2312", "gbk", "big5", "ascii", "latin-1")
DELIMITERS = ",;\t|"
QA_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("question", "answer", "similar_questions", "category", "tags", "enabled")])
REQUIRED = ("question", "answer")


def delimiter_of(lines: list[str]) -> str:
    """The delimiter of a file, from its first five lines."""
    head = "\n".join(lines[:5])
    try:
        return csv.Sniffer().sniff(head, delimiters=DELIMITERS).delimiter
    except csv.Error:
        counts = {d: head.count(d) for d in DELIMITERS}
        return max(counts, key=counts.get) if any(counts.values()) else ","


def read_delimited(spark: SparkSession, path: str, most_rows: int | None = None) -> DataFrame:
    """A delimited file with a header; the delimiter is found from its first lines, blank rows go, cells are trimmed."""
    head = [r.value for r in spark.read.text(path).limit(5).collect()]
    rows = spark.read.csv(path, sep=delimiter_of(head), header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.filter(F.concat_ws("", *(F.col(f"`{c}`") for c in rows.columns)) != "")
    return rows if most_rows is None else rows.limit(most_rows)


def table_rows(rows: DataFrame, sheet: str) -> DataFrame:
    """One record a row: sheet_name, header, values."""
    header = F.array(*(F.lit(c) for c in rows.columns))
    return rows.select(F.lit(sheet).alias("sheet_name"), header.alias("header"), F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns)).alias("values"))


def markdown_row(values: Column) -> Column:
    """A row of a pipe table."""
    cells = F.transform(values, lambda v: F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """A question-and-answer template: required columns are checked first, lists split, `enabled` read in two languages."""
    head = [c.strip().lstrip("﻿") for c in spark.read.csv(path, header=True).columns]
    missing, unknown = set(REQUIRED) - set(head), set(head) - set(QA_SCHEMA.names)
    if missing or unknown:
        raise ValueError(f"missing columns {sorted(missing)}, unknown columns {sorted(unknown)}")
    rows = spark.read.csv(path, header=True, schema=T.StructType([QA_SCHEMA[c] for c in head]), multiLine=True, escape='"')
    for c in set(QA_SCHEMA.names) - set(head):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    return rows.select(strip(F.col("question")).alias("question"), strip(F.col("answer")).alias("answer"), similar_questions("similar_questions").alias("similar_questions"), strip(F.col("category")).alias("category"), tags_of("tags").alias("tags"), enabled(F.col("enabled")).alias("is_enabled"))


def enabled(c: Column) -> Column:
    v = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(v.isin("", "true", "1", "yes", "y", "是", "启用"), True).when(v.isin("false", "0", "no", "n", "否", "停用", "禁用"), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), v)).cast("boolean"))


def qa_for_csv(rows: DataFrame) -> DataFrame:
    """Question-and-answer rows with lists joined, as they are written to a file."""
    return rows.select("question", "answer", F.array_join("similar_questions", "||").alias("similar_questions"), "category", F.array_join("tags", ",").alias("tags"), F.lower(F.col("is_enabled").cast("string")).alias("enabled"))


def decoded(files: DataFrame) -> DataFrame:
    """path, text, encoding of files read as bytes: the first encoding that fits."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_decode(bytes(c)) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "text": [t for t, _ in found], "encoding": [e for _, e in found]})

    return files.select("path", "content").mapInPandas(decode, "path string, text string, encoding string")


def _decode(content: bytes) -> tuple[str, str]:
    for encoding in ENCODINGS[:-1]:
        try:
            return content.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return content.decode(ENCODINGS[-1]), ENCODINGS[-1]


def path_fields(key: Column) -> Column:
    """root, owner and name of a storage key root/owner/.../name."""
    parts = F.split(key, "/")
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("root"), F.try_element_at(parts, F.lit(2)).alias("owner"), F.try_element_at(parts, F.lit(-1)).alias("name"))


def is_temporary(key: Column) -> Column:
    parts = F.split(key, "/")
    second, third = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    return F.coalesce((second == "temp") | ((second == "documents") & (third == "temp")), F.lit(False))


def parser_for(path: Column) -> Column:
    """Which reader a file goes to, by its extension."""
    e = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(e.isin("csv", "tsv"), "delimited").when(e.isin("md", "markdown"), "markdown").when(e.isin("html", "htm", "xml"), "page").when(e.isin("json", "yaml", "yml", "toml", "ini"), "config").when(e.isin("pdf", "docx", "doc", "xlsx", "xls"), "office").otherwise("text")
