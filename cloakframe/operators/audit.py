"""Audit events and metrics as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import native
from cloakframe.policy import Policy
from cloakframe.types import TYPES


def audit_name(pii_type: Column) -> Column:
    out = F.lit("other")
    for t in TYPES.values():
        out = F.when(pii_type == t.name, t.audit).otherwise(out)
    return out


def timestamp(at: Column | None = None) -> Column:
    return F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def detection_events(df: DataFrame, *keys: str, detections: str = "detections", policy: Policy | None = None) -> DataFrame:
    """An event for each detection: type, confidence, place, byte length, what stands for it."""
    policy = policy or Policy()
    each = df.select(*keys, F.posexplode_outer(detections).alias("i", "d")).where("d is not null")
    return each.select(
        *keys,
        F.lit("pii_detected").alias("event"),
        audit_name(F.col("d.pii_type")).alias("pii_type"),
        F.col("d.confidence").alias("confidence"),
        F.col("d.start").alias("start"),
        F.col("d.end").alias("end"),
        (F.col("d.end") - F.col("d.start")).alias("original_len"),
        native.form(policy, F.col("d"), F.col("i")).alias("redacted_form"),
    )


def request_events(df: DataFrame, *keys: str, text: str = "text", redacted: str = "redacted") -> DataFrame:
    """An event for each text that isn't empty, from a struct<text, detections, changed> column."""
    n = F.size(f"{redacted}.detections")
    return df.where(F.length(text) > 0).select(*keys, F.lit("request_processed").alias("event"), (n > 0).alias("had_pii"), n.alias("detection_count"), F.col(f"{redacted}.changed").alias("redacted"))


def custom_event(df: DataFrame, category: str, message: str) -> DataFrame:
    return df.sparkSession.createDataFrame([("custom", category, message)], "event string, category string, message string")


def as_json(events: DataFrame, at: Column | None = None) -> DataFrame:
    """One JSON line for each event, null fields left out."""
    return events.select(F.to_json(F.struct(timestamp(at).alias("timestamp"), *events.columns), {"ignoreNullFields": "true"}).alias("value"))


def pii_counters(df: DataFrame, *by: str, detections: str = "detections") -> DataFrame:
    """Detections by type and the given columns, and their totals, in one pass (rollup over partial aggregates)."""
    each = df.select(*by, F.explode_outer(detections).alias("d")).where("d is not null").select(*by, F.col("d.pii_type").alias("pii_type"))
    return each.rollup(*by, "pii_type").agg(F.count("*").alias("n"))


def request_counters(requests: DataFrame) -> DataFrame:
    """Requests by endpoint and by status, from rows (method, path, status), as grouping sets of one aggregation."""
    endpoint = F.concat_ws(" ", "method", "path")
    rows = requests.select(endpoint.alias("endpoint"), F.col("status").cast("string").alias("status"))
    return rows.groupingSets([["endpoint", "status"], ["endpoint"], ["status"], []], "endpoint", "status").agg(F.count("*").alias("n"))


def provider_counters(answered: DataFrame, provider: str = "provider", kind: str = "error_kind") -> DataFrame:
    """(metric, provider, error, n): requests sent to each provider, and errors by kind, from rows as of chat.exchange(); one aggregation."""
    sent = answered.where(F.col("status") != 404).select(F.col(provider).alias("provider"), F.col(kind).alias("error"))
    each = sent.groupingSets([["provider"], ["provider", "error"]], "provider", "error").agg(F.count("*").alias("n"), F.grouping("error").alias("whole"))
    return each.where("whole = 1 or error is not null").select(F.when(F.col("whole") == 1, "requests").otherwise("errors").alias("metric"), "provider", "error", "n")


def duration_histogram(requests: DataFrame, column: str = "duration", bounds: tuple[float, ...] = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)) -> DataFrame:
    """(le, n): requests of at most le seconds; one aggregation with a sum for each bound."""
    sums = requests.agg(*[F.sum((F.col(column) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(column).alias("all"))
    pairs = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return sums.select(F.explode(pairs).alias("x")).select("x.*")


def exposition(counters: DataFrame, name: str, label: str, value: str = "n") -> DataFrame:
    """Prometheus text: a line for each labelled value."""
    return counters.select(F.concat(F.lit(f'{name}{{{label}="'), F.coalesce(F.col(label), F.lit("")), F.lit('"} '), F.col(value).cast("string")).alias("value"))
