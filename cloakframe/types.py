"""Types of personal data, their fixed properties, and the Spark schemas of results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

HIGH, MEDIUM, LOW = "high", "medium", "low"
CONFIDENCE_RANK = {HIGH: 3, MEDIUM: 2, LOW: 1}


@dataclass(frozen=True)
class PiiType:
    """name: snake case. order: place among the detectors, the last tie-break. token: stem of a typed token."""

    name: str
    placeholder: str
    basis: str
    confidence: str
    priority: int
    checksum: bool
    cli: str
    audit: str
    token: str
    aliases: tuple[str, ...] = ()
    anchors: tuple[str, ...] = ()


# The built-in types in detector order, with their observable strings, ranks and anchor words.
_TYPES = (
    PiiType("email", "[REDACTED_EMAIL]", "GDPR Art.4(1), CCPA §1798.140(o)", MEDIUM, 1, False, "email", "email", "EMAIL", (), ("@",)),
    PiiType("phone_number", "[REDACTED_PHONE]", "GDPR Recital 30 + national telecom laws", MEDIUM, 2, False, "phone", "phonenumber", "PHONE", ("phone",)),
    PiiType("ssn", "[REDACTED_SSN]", "NIST SP 800-122 §2.1", HIGH, 5, True, "ssn", "ssn", "SSN", (), ("-",)),
    PiiType("credit_card", "[REDACTED_CC]", "PCI-DSS v4.0 + GDPR financial data", HIGH, 4, True, "credit_card", "creditcard", "CC", (), (" -", " ")),
    PiiType("ip_address_v4", "[REDACTED_IPv4]", "GDPR Recital 30", HIGH, 1, False, "ipv4", "ipaddressv4", "PII", ("ipv4",), (".",)),
    PiiType("ip_address_v6", "[REDACTED_IPv6]", "GDPR Recital 30", HIGH, 1, False, "ipv6", "ipaddressv6", "PII", ("ipv6",), (":",)),
    PiiType("iban", "[REDACTED_IBAN]", "PSD2 Art.69 + GDPR financial data", HIGH, 3, True, "iban", "iban", "PII"),
    PiiType("passport_number", "[REDACTED_PASSPORT]", "GDPR Art.4(1) + ICAO 9303", MEDIUM, 3, False, "passport", "passportnumber", "PII", ("passport",), ("passport", "passport no", "passport number", "travel document")),
    PiiType("national_id", "[REDACTED_NATID]", "GDPR Art.4(1) + national ID regulations", MEDIUM, 3, False, "national_id", "nationalid", "PII", (), ("aadhaar", "pan", "tfn", "tax file number", "medicare", "national id", "personalausweis", "numéro insee")),
    PiiType("physical_address", "[REDACTED_ADDRESS]", "GDPR Art.4(1) + CCPA §1798.140(v)", LOW, 1, False, "address", "physicaladdress", "PII", ("address",), ("address", "street", "avenue", "boulevard", "drive", "road", "lane", "court", "place", "way", "residence", "located at", "mailing address")),
)
TYPES: dict[str, PiiType] = {t.name: t for t in _TYPES}
BUILT_IN = tuple(TYPES)
ORDER = {name: i for i, name in enumerate(BUILT_IN)}
ALIASES = {a: t.name for t in _TYPES for a in (t.name, t.cli, *t.aliases)}


def other(label: str) -> str:
    """The name of a custom type."""
    return f"other:{label}"


def info(name: str) -> PiiType:
    """Properties of a type; custom types share one set."""
    if name in TYPES:
        return TYPES[name]
    label = name.removeprefix("other:")
    return PiiType(name, "[REDACTED_OTHER]", "Contextual PII (NER-detected)", LOW, 0, False, label, "other", label.upper())


def type_from_config(value) -> str | None:
    """The type that a configuration names; custom ones ({"other": label}) can't be configured and give None."""
    return value if isinstance(value, str) and value in TYPES else None


def type_to_config(name: str):
    return {"other": name.removeprefix("other:")} if name.startswith("other:") else name


DETECTION = T.StructType(
    [
        T.StructField("pii_type", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("original", T.StringType()),
    ]
)
DETECTIONS = T.ArrayType(DETECTION)
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
