"""Arrow functions over the kernel, for what Catalyst expressions can't say: whole batches cross to Python once."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe import kernel
from cloakframe.functions.blake3 import blake3_hex
from cloakframe.policy import Policy
from cloakframe.types import DETECTIONS

_FOUND = pa.list_(pa.struct([("pii_type", pa.string()), ("confidence", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("original", pa.string())]))
_WINDOWS = T.ArrayType(T.StructType([T.StructField("detector", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _map(col: Column, fn: Callable, kind, arrow: pa.DataType) -> Column:
    @F.arrow_udf(returnType=kind)
    def run(a: pa.Array) -> pa.Array:
        return pa.array([fn(x) for x in a.to_pylist()], arrow)

    return run(col)


def _rows(found) -> list[dict]:
    return [f._asdict() for f in found]


def detect_one(col: Column, detector, strict: bool = True) -> Column:
    """Detections of one detector over the whole text; null text gives an empty array."""
    return _map(col, lambda t: _rows(kernel.detect_one(detector, t, strict)), DETECTIONS, _FOUND)


def detect(col: Column, detectors: list | None = None, strict: bool = True, anchored: bool = True, drop_original: bool = False) -> Column:
    """Detections of all detectors, overlaps resolved."""
    dets = kernel.built_in() if detectors is None else detectors

    def one(t):
        rows = _rows(kernel.detect(dets, t, strict, anchored))
        return [{**r, "original": None} for r in rows] if drop_original else rows

    return _map(col, one, DETECTIONS, _FOUND)


def anchor_windows(col: Column, detectors: list | None = None) -> Column:
    dets = kernel.built_in() if detectors is None else detectors

    def one(t):
        w = kernel.anchor_windows(dets, t or "")
        return [{"detector": d.pii_type, "start": a, "end": b} for d, x in zip(dets, w, strict=True) for a, b in x or ()]

    return _map(col, one, _WINDOWS, pa.list_(pa.struct([("detector", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))


def redact(col: Column, policy: Policy | None = None, detectors: list | None = None, anchored: bool | str = True, overlap: str = "repeat") -> Column:
    """The redacted text; null stays null. anchored: as kernel.detect() has it."""
    p, dets = policy or Policy(), kernel.built_in() if detectors is None else detectors
    return _map(col, lambda t: None if t is None else kernel.redact(dets, p, t, anchored, overlap).text, T.StringType(), pa.string())


REDACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("detections", DETECTIONS), T.StructField("changed", T.BooleanType())])


def redact_full(col: Column, policy: Policy | None = None, detectors: list | None = None, anchored: bool = True, overlap: str = "repeat") -> Column:
    """struct<text, detections, changed>: the text, the matches replaced and whether anything was."""
    p, dets = policy or Policy(), kernel.built_in() if detectors is None else detectors

    def one(t):
        r = kernel.redact(dets, p, t, anchored, overlap)
        return {"text": None if t is None else r.text, "detections": _rows(r.kept), "changed": r.changed}

    return _map(col, one, REDACTED, pa.struct([("text", pa.string()), ("detections", _FOUND), ("changed", pa.bool_())]))


def typed_tokens(col: Column, detectors: list | None = None, anchored: bool = True) -> Column:
    """Text with typed tokens, numbered anew in each text from its last match."""
    dets = kernel.built_in() if detectors is None else detectors
    return _map(col, lambda t: None if t is None else kernel.TokenRedactor().redact(t, kernel.detect(dets, t, True, anchored)), T.StringType(), pa.string())


def blake3(col: Column) -> Column:
    return _map(col, lambda t: None if t is None else blake3_hex(t.encode("utf-8", "surrogatepass")), T.StringType(), pa.string())


JSON = T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])


class _Number(str):
    """A number as it was written."""


def _dump(x, pretty: bool, level: int = 0) -> str:
    line, end = ("\n" + "  " * (level + 1), "\n" + "  " * level) if pretty else ("", "")
    if isinstance(x, dict):
        items = [f"{json.dumps(k, ensure_ascii=False)}:{' ' * pretty}{_dump(x[k], pretty, level + 1)}" for k in sorted(x)]
        return "{" + line + ("," + line).join(items) + end + "}" if items else "{}"
    if isinstance(x, list):
        return "[" + line + ("," + line).join(_dump(v, pretty, level + 1) for v in x) + end + "]" if x else "[]"
    return str(x) if isinstance(x, _Number) else json.dumps(x, ensure_ascii=False)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def parse_json(doc: str):
    """A JSON document whose numbers stay as written."""
    return json.loads(doc, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)


def redact_leaves(x, fn: Callable[[str], str]):
    if isinstance(x, dict):
        return {k: redact_leaves(v, fn) for k, v in x.items()}
    if isinstance(x, list):
        return [redact_leaves(v, fn) for v in x]
    return fn(x) if isinstance(x, str) and not isinstance(x, _Number) else x


def redact_json(col: Column, policy: Policy | None = None, detectors: list | None = None, pretty: bool = False, anchored: bool = True) -> Column:
    """struct<json, error>: every string value redacted on its own, keys sorted, all else as it was. A broken document gives an error and no json."""
    p, dets = policy or Policy(), kernel.built_in() if detectors is None else detectors

    def one(doc):
        if doc is None:
            return None
        try:
            return {"json": _dump(redact_leaves(parse_json(doc), lambda s: kernel.redact(dets, p, s, anchored).text), pretty), "error": None}
        except (ValueError, RecursionError) as e:
            return {"json": None, "error": str(e)}

    return _map(col, one, JSON, pa.struct([("json", pa.string()), ("error", pa.string())]))


def strip_internal_fields(col: Column, prefix: str = "_internal_") -> Column:
    """A request without ``provider`` and the keys with the prefix, at the top level; what is no object stays as it is."""

    def one(doc):
        if doc is None:
            return None
        try:
            x = parse_json(doc)
        except (ValueError, RecursionError):
            return doc
        return _dump({k: v for k, v in x.items() if k != "provider" and not k.startswith(prefix)}, False) if isinstance(x, dict) else doc

    return _map(col, one, T.StringType(), pa.string())
