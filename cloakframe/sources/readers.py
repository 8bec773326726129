"""Where texts, documents and settings come from, and the reports that go out."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_input(spark: SparkSession, text: str | None = None, file: str | None = None) -> DataFrame:
    """One row (text): the argument, else a whole file (or a row for each file of a folder), else standard input."""
    if text is not None:
        return spark.createDataFrame([(text,)], "text string")
    if file is not None:
        return spark.read.text(file, wholetext=True).withColumnRenamed("value", "text")
    return spark.createDataFrame([(sys.stdin.read(),)], "text string")


def read_table(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """Any of Spark's own sources: parquet, orc, csv, json, avro, jdbc ..."""
    return spark.read.format(form).options(**options).load(path)


def with_json_error(df: DataFrame, column: str = "json") -> DataFrame:
    """df with ``error`` where the column holds no JSON document."""
    return df.withColumn("error", F.when(F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull(), "invalid JSON"))


def redact_report(text: Column, redacted: Column, pretty: bool = True) -> Column:
    """{input, redacted, changed} as JSON."""
    return F.to_json(F.struct(text.alias("input"), redacted.alias("redacted"), (text != redacted).alias("changed")), {"pretty": "true"} if pretty else {})


def validate_report(text: Column, detections: Column, redacted: Column, pretty: bool = True) -> Column:
    """{input, detections, count, has_pii, redacted} as JSON."""
    listed = F.transform(detections, lambda d: F.struct(d["pii_type"].alias("type"), d["start"].alias("start"), d["end"].alias("end"), d["original"].alias("original")))
    return F.to_json(F.struct(text.alias("input"), listed.alias("detections"), F.size(detections).alias("count"), (F.size(detections) > 0).alias("has_pii"), redacted.alias("redacted")), {"pretty": "true"} if pretty else {})


def validate_text(detections: Column) -> Column:
    """The report as lines of text."""
    lines = F.transform(detections, lambda d: F.format_string("  - %s: %s (%d-%d)", d["pii_type"], d["original"], d["start"], d["end"]))
    return F.when(F.size(detections) == 0, "No PII detected.").otherwise(F.concat(F.format_string("Found %d PII detection(s):\n", F.size(detections)), F.array_join(lines, "\n")))
