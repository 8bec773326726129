"""Detection and redaction of a text column of a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from cloakframe import kernel
from cloakframe.functions import arrow, native
from cloakframe.policy import Policy
from cloakframe.types import DETECTION, DETECTIONS, TYPES


def with_detections(df: DataFrame, text: str = "text", out: str = "detections", types: Iterable[str] | None = None, strict: bool = True, anchored: bool = True, detectors: list | None = None) -> DataFrame:
    """df with the resolved detections of each text.

    Over whole texts (anchored=False) and types that Catalyst can find, the plan has no Python; else one Arrow function runs.
    """
    if detectors is None and not anchored and types is not None and set(types) <= set(native.NATIVE):
        return df.withColumn(out, native.detect_all(F.col(text), tuple(types), strict))
    dets = detectors if detectors is not None else kernel.built_in(types or tuple(TYPES))
    return df.withColumn(out, arrow.detect(F.col(text), dets, strict, anchored))


def exploded(df: DataFrame, *keys: str, detections: str = "detections") -> DataFrame:
    """A row for each detection: keys, its place among those of the text, its fields.

    posexplode_outer, since the optimiser puts a filter on the array below posexplode, and with it computes the detections again.
    """
    return df.select(*keys, F.posexplode_outer(detections).alias("position", "d")).where("d is not null").select(*keys, "position", "d.*")


def redacted(df: DataFrame, policy: Policy | None = None, text: str = "text", out: str = "redacted", detectors: list | None = None, anchored: bool = True) -> DataFrame:
    """df with ``out``: struct<text, detections, changed>, from one pass over each text."""
    return df.withColumn(out, arrow.redact_full(F.col(text), policy, detectors, anchored))


def regulatory(df: DataFrame, pii_type: str = "pii_type") -> DataFrame:
    """df with placeholder, regulatory_basis and requires_validation of each type; the dimension has as many rows as types."""
    spark = df.sparkSession
    rows = [(t.name, t.placeholder, t.basis, t.checksum) for t in TYPES.values()]
    dim = spark.createDataFrame(rows, f"{pii_type} string, placeholder string, regulatory_basis string, requires_validation boolean")
    return df.join(F.broadcast(dim), pii_type, "left")


def register_sql(spark: SparkSession, policy: Policy | None = None) -> None:
    """detect_pii(text), redact_pii(text) and redact_pii_json(doc) for SQL, and detected_pii(text) as a table function."""
    p, dets = policy or Policy(), kernel.built_in()
    @pandas_udf(DETECTIONS)
    def detect_pii(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [f._asdict() for f in kernel.detect(dets, t, p.strict)])

    @pandas_udf("string")
    def redact_pii(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else kernel.redact(dets, p, t).text)

    @pandas_udf("string")
    def redact_pii_json(s: pd.Series) -> pd.Series:
        def one(doc):
            try:
                return arrow._dump(arrow.redact_leaves(arrow.parse_json(doc), lambda x: kernel.redact(dets, p, x).text), False)
            except (TypeError, ValueError):
                return None

        return s.map(one)

    @udtf(returnType=DETECTION)
    class DetectedPii:
        def eval(self, text: str):
            for f in kernel.detect(dets, text, p.strict):
                yield tuple(f)

    spark.udf.register("detect_pii", detect_pii)
    spark.udf.register("redact_pii", redact_pii)
    spark.udf.register("redact_pii_json", redact_pii_json)
    spark.udtf.register("detected_pii", DetectedPii)
