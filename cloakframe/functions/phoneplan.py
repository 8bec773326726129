"""Lengths of national phone numbers: enough to tell numbers from other digits, not whether they are in service."""

from __future__ import annotations

# Country, calling code, trunk prefix, shortest and longest national number.
PLANS = {
    "US": ("1", "1", 10, 10),
    "CA": ("1", "1", 10, 10),
    "GB": ("44", "0", 9, 10),
    "DE": ("49", "0", 6, 11),
    "FR": ("33", "0", 9, 9),
    "AU": ("61", "0", 9, 9),
    "JP": ("81", "0", 9, 10),
    "IN": ("91", "0", 10, 10),
    "ES": ("34", "", 9, 9),
    "IT": ("39", "", 6, 11),
    "NL": ("31", "0", 9, 9),
    "CH": ("41", "0", 9, 9),
    "AT": ("43", "0", 7, 13),
    "BE": ("32", "0", 8, 9),
    "SE": ("46", "0", 7, 10),
    "PL": ("48", "", 9, 9),
    "BR": ("55", "0", 10, 11),
    "MX": ("52", "", 10, 10),
    "CN": ("86", "0", 9, 11),
    "KR": ("82", "0", 8, 10),
    "SG": ("65", "", 8, 8),
    "NZ": ("64", "0", 8, 10),
    "ZA": ("27", "0", 9, 9),
}
DEFAULT_COUNTRIES = ("US", "GB", "DE", "FR", "CA", "AU", "JP")
#: Digit strings that are never a number.
NEVER = ("0000000000", "1111111111", "1234567890")


def national_lengths(country: str) -> list[tuple[str, int]]:
    """(digits that it begins with, how many digits) of the forms in which a country's numbers are dialled at home."""
    _, trunk, lo, hi = PLANS[country]
    return [("", n) for n in range(lo, hi + 1)] + [(trunk, n + len(trunk)) for n in range(lo, hi + 1) if trunk]


def is_international(digits: str) -> bool:
    """digits: all after the plus sign. Known calling codes have their lengths, others those that the numbering plan allows."""
    if digits[:1] in ("", "0"):
        return False
    known = [p for p in PLANS.values() if digits.startswith(p[0])]
    if known:
        return any(lo <= len(digits) - len(code) <= hi + len(trunk) for code, trunk, lo, hi in known)
    return 8 <= len(digits) <= 15


def is_national(digits: str, countries) -> bool:
    return any(len(digits) == n and digits.startswith(head) for c in countries if c in PLANS for head, n in national_lengths(c))
