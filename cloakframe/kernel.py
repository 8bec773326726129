"""Detection and redaction of one text. The Arrow functions apply it to columns; tests hold the Catalyst expressions against it.

Places are UTF-8 byte offsets in results and code points inside.
"""

from __future__ import annotations

import bisect
import ipaddress
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import NamedTuple, Protocol

from cloakframe.functions import phoneplan
from cloakframe.functions.blake3 import blake3_hex
from cloakframe.policy import Policy
from cloakframe.types import BUILT_IN, CONFIDENCE_RANK, HIGH, LOW, MEDIUM, info, other

BLOCK = "█"
WINDOW = 64
WORDS = "words"

# Candidate patterns of the built-in types.
PATTERNS = {
    "email": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
    "phone_number": r"\+?[\d\s\-\.\(\)]{7,25}",
    "ssn": r"\b(?:\d{3}-\d{2}-\d{4}|\d{9})\b",
    "credit_card": r"\d(?:[ -]*\d){12,18}",
    "ip_address_v4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ip_address_v6": r"[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){1,7}(?:\.\d{1,3}){0,3}",
    "iban": r"\b[A-Z]{2}\d{2}[ -]?[A-Z0-9](?:[ -]?[A-Z0-9]){3,33}\b",
    "passport_number": r"\b(?:[A-Z]{1,2}\d{6,10}|\d{6,10}[A-Z]?)\b",
    "national_id": r"\b\d{4}\s?\d{4}\s?\d{4}\b|\b[A-Z]{5}\d{4}[A-Z]\b|\b\d{3}\s?\d{3}\s?\d{3}\b|\b\d{3}\s?\d{5}\b|\b[12]\d{12}\b",
}
# Street and unit words.
STREET_TYPES = "street st avenue ave boulevard blvd drive dr lane ln road rd court ct place pl way circle trail trl parkway pkwy highway hwy terrace ter".split()
UNIT_TYPES = "suite ste apt unit floor fl".split()

_STREET = "|".join(sorted(STREET_TYPES, key=len, reverse=True))
_TAIL = re.compile(rf"(?:\s+(?:{'|'.join(UNIT_TYPES)})\s+\S+)?(?:,\s*\w+(?:\s+\w+)*?)?(?:,\s*[a-z]{{2}}\s+\d{{5}}(?:-\d{{4}})?)?\b", re.I)
_RX = {k: re.compile(p) for k, p in PATTERNS.items()}


class Found(NamedTuple):
    pii_type: str
    confidence: str
    start: int
    end: int
    original: str


def ascii_alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def closed(text: str, start: int, end: int, of: Callable[[str], bool] = ascii_alnum) -> bool:
    return not (start and of(text[start - 1])) and not (end < len(text) and of(text[end]))


def ascii_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    if len(digits) < 2 or not digits.isascii() or not digits.isdigit():
        return False
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def card_network(digits: str) -> str | None:
    """Issuer ranges and the lengths that their networks use."""
    n, p = len(digits), lambda k: int(digits[:k] or 0)
    if digits[:1] == "4" and n in (13, 16):
        return "visa"
    if n == 16 and (51 <= p(2) <= 55 or 2221 <= p(4) <= 2720):
        return "mastercard"
    if p(4) == 6011 or p(2) == 65 or 644 <= p(3) <= 649 or n == 16 and 622126 <= p(6) <= 622925:
        return "discover"
    if n == 15 and p(2) in (34, 37):
        return "amex"
    if n == 16 and 3528 <= p(4) <= 3589:
        return "jcb"
    if n == 14 and (300 <= p(3) <= 305 or p(3) == 309 or p(2) in (36, 38, 39)):
        return "diners"
    if p(4) in (5018, 5020, 5038, 5893, 6304, 6759, 6761, 6762, 6763):
        return "maestro"
    if p(2) in (62, 81) and 16 <= n <= 19:
        return "unionpay"
    return None


def iban_valid(candidate: str) -> bool:
    s = re.sub(r"[\s-]", "", candidate)
    if not 15 <= len(s) <= 34 or not s.isascii() or not s.isalnum() or s != s.upper():
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn_valid(candidate: str) -> bool:
    d = candidate.replace("-", "")
    if len(d) != 9 or not d.isascii():
        return False
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def ipv4_valid(candidate: str) -> bool:
    parts = candidate.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 and (p == "0" or p[0] != "0") for p in parts)


def ipv6_valid(candidate: str) -> bool:
    try:
        ipaddress.IPv6Address(candidate)
    except ValueError:
        return False
    return True


def _email(text: str, strict: bool) -> Iterable[tuple[int, int]]:
    if "@" in text:
        for m in _RX["email"].finditer(text):
            if ".." not in m[0].partition("@")[0]:
                yield m.span()


def _phone(countries):
    def find(text: str, strict: bool) -> Iterable[tuple[int, int]]:
        for m in _RX["phone_number"].finditer(text):
            raw = m[0]
            start = m.start() + len(raw) - len(raw.lstrip())
            end = m.end() - len(raw) + len(raw.rstrip())
            if end <= start or not closed(text, start, end):
                continue
            digits = ascii_digits(text[start:end])
            if not 7 <= len(digits) <= 15 or digits in phoneplan.NEVER:
                continue
            if phoneplan.is_international(digits) if text[start] == "+" else phoneplan.is_national(digits, countries):
                yield start, end

    return find


def _ssn(text: str, strict: bool) -> Iterable[tuple[int, int]]:
    for m in _RX["ssn"].finditer(text):
        if not strict or ssn_valid(m[0]):
            yield m.span()


def _card(text: str, strict: bool) -> Iterable[tuple[int, int]]:
    for m in _RX["credit_card"].finditer(text):
        if closed(text, *m.span(), of=lambda c: "0" <= c <= "9"):
            d = ascii_digits(m[0])
            if 13 <= len(d) <= 19 and (not strict or luhn(d) and card_network(d)):
                yield m.span()


def _ipv4(text: str, strict: bool) -> Iterable[tuple[int, int]]:
    for m in _RX["ip_address_v4"].finditer(text):
        if not strict or ipv4_valid(m[0]):
            yield m.span()


def _ipv6(text: str, strict: bool) -> Iterable[tuple[int, int]]:
    for m in _RX["ip_address_v6"].finditer(text):
        if closed(text, *m.span(), of=lambda c: c in "0123456789abcdefABCDEF:") and (not strict or ipv6_valid(m[0])):
            yield m.span()


def _iban(text: str, strict: bool) -> Iterable[tuple[int, int]]:
    for m in _RX["iban"].finditer(text):
        if iban_valid(m[0]) and closed(text, *m.span()):
            yield m.span()


def _passport(text: str, strict: bool) -> Iterable[tuple[int, int]]:
    for m in _RX["passport_number"].finditer(text):
        if m[0].isascii() and closed(text, *m.span()):
            yield m.span()


def _national_id(text: str, strict: bool) -> Iterable[tuple[int, int]]:
    for m in _RX["national_id"].finditer(text):
        if m[0].replace("\xa0", " ").isascii() and closed(text, *m.span()):
            yield m.span()


_NUMBER = re.compile(r"\b\d{1,6}(?=\s+\w)")
_WORDS = re.compile(r"\w+(?:\s+\w+)*")
_STREET_END = re.compile(rf"\s+(?:{_STREET})", re.I)
_HAS_STREET = re.compile(rf"\b(?:{_STREET})\b", re.I)


def _address(text: str, strict: bool) -> Iterable[tuple[int, int]]:
    """A number, words, the last street type that fits, then unit, city and code. Each run of words is cut out once, so long prose is no trouble."""
    if not _HAS_STREET.search(text):
        return
    at = 0
    while m := _NUMBER.search(text, at):
        run = _WORDS.match(text, m.end() + len(text[m.end() : m.end() + 256]) - len(text[m.end() : m.end() + 256].lstrip()))
        at = m.end()
        if not run:
            continue
        # the words are greedy: the last place where a street type begins after at least one word wins, if the rest fits
        for s in reversed(list(_STREET_END.finditer(text, run.start() + 1, run.end()))):
            t = _TAIL.match(text, s.end())
            if t:
                end = t.end()
                got = text[m.start() : end]
                at = end
                if len(got.encode()) >= 8 and _HAS_STREET.search(got) and closed(text, m.start(), end):
                    yield m.start(), end
                break


_DIGIT = re.compile(r"\d")
_NEEDS: dict[str, Callable[[str], object]] = {"email": lambda t: "@" in t, "ip_address_v6": lambda t: ":" in t}


class Detector(Protocol):
    """What a detector of one's own needs."""

    pii_type: str
    confidence: str
    anchors: tuple[str, ...]

    def spans(self, text: str, strict: bool) -> Iterable[tuple[int, int]]: ...


@dataclass(frozen=True)
class BuiltIn:
    pii_type: str
    find: Callable[[str, bool], Iterable[tuple[int, int]]]

    @property
    def confidence(self) -> str:
        return info(self.pii_type).confidence

    @property
    def anchors(self) -> tuple[str, ...]:
        return info(self.pii_type).anchors

    def may_find(self, text: str) -> bool:
        """A cheap test that every text with a match passes."""
        return bool(_NEEDS.get(self.pii_type, _DIGIT.search)(text))

    def spans(self, text: str, strict: bool):
        return self.find(text, strict)


@dataclass(frozen=True)
class Custom:
    """A pattern of one's own. flags: letters as in (?flags)."""

    name: str
    pattern: str
    placeholder: str = "[REDACTED]"
    confidence: str = MEDIUM
    flags: str | None = None
    anchors: tuple[str, ...] = ()

    @property
    def pii_type(self) -> str:
        return other(self.name)

    def spans(self, text: str, strict: bool):
        return (m.span() for m in re.finditer(f"(?{self.flags})" * bool(self.flags) + self.pattern, text) if m.end() > m.start())


def custom_detectors(configs: Iterable[dict]) -> tuple[list[Custom], list[str]]:
    """The valid ones, and an error for each of the others."""
    good, errors = [], []
    for c in configs:
        level = str(c.get("confidence", MEDIUM)).lower()
        d = Custom(c["name"], c["pattern"], c.get("placeholder", "[REDACTED]"), level if level in CONFIDENCE_RANK else MEDIUM, c.get("flags"))
        try:
            re.compile(f"(?{d.flags})" * bool(d.flags) + d.pattern)
        except re.error as e:
            errors.append(f"Invalid regex for {d.name!r}: {e}")
        else:
            good.append(d)
    return good, errors


@dataclass(frozen=True)
class Names:
    """Capitalised words of letters only. Places are exact, also after several blanks."""

    pii_type: str = other("PERSON")
    confidence: str = LOW
    anchors: tuple[str, ...] = ()

    def spans(self, text: str, strict: bool):
        for m in re.finditer(r"\S+", text):
            w = m[0]
            lo = next((i for i, c in enumerate(w) if c.isalpha()), len(w))
            hi = next((i for i in range(len(w), lo, -1) if w[i - 1].isalpha()), lo)
            core = w[lo:hi]
            if core and core[0].isupper() and len(core.encode()) > 1 and core.isalpha():
                yield m.start() + lo, m.start() + hi


@dataclass(frozen=True)
class NerModel:
    """A place for a trained model; finds nothing."""

    pii_type: str = other("NER")
    confidence: str = HIGH
    anchors: tuple[str, ...] = ()

    def spans(self, text: str, strict: bool):
        return ()


def built_in(names: Iterable[str] = BUILT_IN, countries=phoneplan.DEFAULT_COUNTRIES) -> list[BuiltIn]:
    finders = dict(zip(BUILT_IN, (_email, _phone(tuple(countries)), _ssn, _card, _ipv4, _ipv6, _iban, _passport, _national_id, _address), strict=True))
    return [BuiltIn(n, finders[n]) for n in names]


class Offsets:
    """From code points to UTF-8 bytes."""

    def __init__(self, text: str):
        self.same = text.isascii()
        if not self.same:
            self.at = [0]
            for c in text:
                self.at.append(self.at[-1] + (1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4))

    def byte(self, i: int) -> int:
        return i if self.same else self.at[i]


def detect_one(detector, text: str | None, strict: bool = True) -> list[Found]:
    """One detector over the whole text."""
    if not text:
        return []
    o = Offsets(text)
    return [Found(detector.pii_type, detector.confidence, o.byte(a), o.byte(b), text[a:b]) for a, b in detector.spans(text, strict)]


def anchor_windows(detectors: list, text: str, o: Offsets | None = None) -> list[list[tuple[int, int]] | None]:
    """For each detector the merged windows around its anchors; None: no anchors of its own, so the whole text."""
    owner: dict[str, int] = {}
    for i, d in enumerate(detectors):
        for a in d.anchors:
            owner.setdefault(a, i)
    windows: list[list[tuple[int, int]] | None] = [[] if d.anchors else None for d in detectors]
    if not owner:
        return [None] * len(detectors)
    o = o or Offsets(text)
    size = o.byte(len(text))
    for m in _anchors(tuple(owner)).finditer(text):
        w = windows[owner[m[0]]]
        lo, hi = max(0, o.byte(m.start()) - WINDOW), min(size, o.byte(m.end()) + WINDOW)
        if w and lo <= w[-1][1]:
            w[-1] = (w[-1][0], max(hi, w[-1][1]))
        else:
            w.append((lo, hi))
    return windows


_ANCHORS: dict[tuple, re.Pattern] = {}


def _anchors(words: tuple[str, ...]) -> re.Pattern:
    if words not in _ANCHORS:
        _ANCHORS[words] = re.compile("|".join(map(re.escape, words)))
    return _ANCHORS[words]


def resolve(found: list[tuple[int, Found]]) -> list[Found]:
    """Of overlapping detections one stays: by type priority, confidence, length; found carries the detector's place, the last tie-break."""

    def rank(f: Found):
        return info(f.pii_type).priority, CONFIDENCE_RANK[f.confidence], f.end - f.start

    out: list[Found] = []
    for _, f in sorted(found, key=lambda x: (x[1].start, *(-r for r in rank(x[1])), x[0])):
        if out and f.start < out[-1].end:
            if rank(f) > rank(out[-1]):
                out[-1] = f
        else:
            out.append(f)
    return out


def _by_word(detector) -> bool:
    return any(c.isalpha() for a in detector.anchors for c in a)


def detect(detectors: list, text: str | None, strict: bool = True, anchored: bool | str = True) -> list[Found]:
    """All detectors, overlaps resolved. anchored: of a detector with anchors only matches that reach into a window around one count.

    Windows are a gate and cut no text: every match and its borders are those of the whole text. anchored=WORDS: only detectors
    whose anchors are words have the gate; a blank or sign nearby says nothing about a number.
    """
    if not text:
        return []
    spans = [(i, a, b) for i, d in enumerate(detectors) if not isinstance(d, BuiltIn) or d.may_find(text) for a, b in d.spans(text, strict)]
    if not spans:
        return []
    o = Offsets(text)
    found = [(i, Found(detectors[i].pii_type, detectors[i].confidence, o.byte(a), o.byte(b), text[a:b])) for i, a, b in spans]
    if anchored and any(detectors[i].anchors for i, _ in found):
        windows = anchor_windows(detectors, text, o)
        if anchored == WORDS:
            windows = [w if _by_word(d) else None for d, w in zip(detectors, windows, strict=True)]
        found = [(i, f) for i, f in found if windows[i] is None or _reaches(windows[i], f)]
    return resolve(found)


def _reaches(windows: list[tuple[int, int]], f: Found) -> bool:
    """Whether a match has a byte in one of the windows, which are disjoint and in order."""
    k = bisect.bisect_right(windows, f.start, key=lambda w: w[1])
    return k < len(windows) and windows[k][0] < f.end


def blocks(s: str) -> str:
    return BLOCK * len(s.encode("utf-8", "surrogatepass"))


def _last_four(s: str) -> str:
    left = len(ascii_digits(s))
    if left < 4:
        return blocks(s)
    out = []
    for c in s:
        if "0" <= c <= "9":
            out.append(c if left <= 4 else BLOCK)
            left -= 1
        else:
            out.append(c)
    return "".join(out)


def mask(pii_type: str, s: str) -> str:
    if pii_type == "email":
        local, at, domain = s.partition("@")
        if not at:
            return blocks(s)
        head, dot, top = domain.rpartition(".")
        return re.sub("[^.]", BLOCK, local) + "@" + (blocks(head) + "." + top if dot else blocks(domain))
    if pii_type in ("phone_number", "ssn"):
        return re.sub("[0-9]", BLOCK, s)
    if pii_type in ("credit_card", "national_id"):
        return _last_four(s)
    if pii_type == "iban":
        c = re.sub(r"[\s-]", "", s)
        if len(c) < 8:
            return blocks(s)
        out = c[:2] + BLOCK * (len(c) - 6) + c[-4:]
        return " ".join(out[i : i + 4] for i in range(0, len(out), 4)) if " " in s else out
    if pii_type == "passport_number":
        m = re.search("[0-9]", s)
        return s if not m else s[: m.start()] + BLOCK * (len(s) - m.start())
    return blocks(s)


def form(policy: Policy, pii_type: str, s: str, number: int) -> str:
    """What stands for a match. number: its place among the matches of the text."""
    if policy.mode == "tokenize":
        return f"[[PII_{number}]]"
    custom = policy.custom_placeholder(pii_type)
    if custom is not None:
        return custom
    if policy.mode == "replace":
        return info(pii_type).placeholder
    if policy.mode == "hash":
        return f"[HASH:{blake3_hex(s.encode('utf-8', 'surrogatepass'))[:16]}]"
    return mask(pii_type, s)


def term_spans(text: str, terms: Iterable[str]) -> list[tuple[int, int]]:
    """Whole-word occurrences (code points), term by term."""
    found = []
    for t in terms:
        at = text.find(t) if t else -1
        while at >= 0:
            if closed(text, at, at + len(t)):
                found.append((at, at + len(t)))
            at = text.find(t, at + len(t))
    return found


class Redacted(NamedTuple):
    text: str
    kept: list[Found]
    changed: bool


def redact(detectors: list, policy: Policy, text: str | None, anchored: bool | str = True, overlap: str = "repeat") -> Redacted:
    """overlap: 'repeat' replaces a blocked term inside a match as well, as two replacements; 'merge' leaves it to the match."""
    if not text:
        return Redacted(text, [], False)
    o = Offsets(text)
    allowed = [(o.byte(a), o.byte(b)) for a, b in term_spans(text, policy.allowlist)]

    def spared(a: int, b: int) -> bool:
        return any(a < y and b > x for x, y in allowed)

    kept = [f for f in detect(detectors, text, policy.strict, anchored) if policy.is_enabled(f.pii_type) and not spared(f.start, f.end)]
    blocked = [(a, b) for x, y in term_spans(text, policy.blocklist) if not spared(a := o.byte(x), b := o.byte(y))]
    if overlap == "merge":
        blocked = [(a, b) for a, b in blocked if not any(a < f.end and b > f.start for f in kept)]
    if not kept and not blocked:
        return Redacted(text, [], False)
    raw = text.encode("utf-8", "surrogatepass")
    spans = sorted([(f.start, f.end, f) for f in kept] + [(a, b, None) for a, b in blocked], key=lambda s: s[0])
    out, at, number = [], 0, 0
    for a, b, f in spans:
        if a > at:
            out.append(raw[at:a].decode("utf-8", "surrogatepass"))
        if f is None:
            out.append(BLOCK * (b - a))
        else:
            out.append(form(policy, f.pii_type, f.original, number))
            number += 1
        at = b
    out.append(raw[at:].decode("utf-8", "surrogatepass"))
    return Redacted("".join(out), kept, True)


class TokenRedactor:
    """Typed tokens; the last match of a text is numbered first, and a value keeps its token as long as the object lives."""

    def __init__(self):
        self.tokens: dict[str, str] = {}

    def redact(self, text: str, found: list[Found]) -> str:
        raw = text.encode("utf-8", "surrogatepass")
        for f in sorted(found, key=lambda f: -f.start):
            if f.original not in self.tokens:
                self.tokens[f.original] = f"[[{info(f.pii_type).token}_{len(self.tokens)}]]"
            raw = raw[: f.start] + self.tokens[f.original].encode() + raw[f.end :]
        return raw.decode("utf-8", "surrogatepass")
