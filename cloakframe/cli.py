"""Command line: redact or validate a text, a file or standard input; list patterns of a configuration."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cloakframe import kernel
from cloakframe.functions import arrow, phoneplan
from cloakframe.policy import Policy, load_settings
from cloakframe.session import ship
from cloakframe.sources import readers
from cloakframe.types import ALIASES


def configured(settings: dict) -> tuple[list, list[str], Policy]:
    """(detectors, errors of custom patterns, policy) of a settings file."""
    section = settings.get("policy", {})
    countries = section.get("phone_countries", phoneplan.DEFAULT_COUNTRIES)
    names = [ALIASES[n] for n in section.get("detectors", []) if n in ALIASES]
    custom, errors = kernel.custom_detectors(section.get("custom_patterns", []))
    return kernel.built_in(names or tuple(dict.fromkeys(ALIASES.values())), countries) + custom, errors, Policy.from_settings(section)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cloakframe", description=__doc__)
    p.add_argument("command", choices=("redact", "validate", "config"))
    p.add_argument("text", nargs="?")
    p.add_argument("--file")
    p.add_argument("--config", default="cloakframe.toml")
    p.add_argument("--format", choices=("text", "json"), default="text")
    a = p.parse_args(argv)
    dets, errors, policy = configured(load_settings(a.config))
    for e in errors:
        print(e)
    if a.command == "config":
        print(policy.to_dict())
        return 1 if errors else 0
    spark = ship(SparkSession.builder.appName("cloakframe").getOrCreate())
    df = readers.read_input(spark, a.text, a.file).withColumn("redacted", arrow.redact(F.col("text"), policy, dets))
    if a.command == "validate":
        df = df.withColumn("found", arrow.detect(F.col("text"), dets))
        out = readers.validate_report(F.col("text"), F.col("found"), F.col("redacted")) if a.format == "json" else readers.validate_text(F.col("found"))
    else:
        out = readers.redact_report(F.col("text"), F.col("redacted")) if a.format == "json" else F.col("redacted")
    for row in df.select(out).toLocalIterator():
        print(row[0])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
