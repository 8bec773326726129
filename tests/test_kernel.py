"""Detector cases of FIXTURES.md and rules of the kernel."""

import random
import re
from pathlib import Path

import pytest

from cloakframe import kernel as K
from cloakframe.functions.blake3 import blake3_hex
from cloakframe.policy import Policy

NAMES = {"email": "email", "phone_number": "phone_number", "ssn": "ssn", "credit_card": "credit_card", "iban": "iban", "passport": "passport_number", "national_id": "national_id", "address": "physical_address", "ip": "ip"}
ONE = {d.pii_type: d for d in K.built_in()}
SIX = K.built_in(["email", "phone_number", "ssn", "credit_card", "ip_address_v4", "ip_address_v6"])


def cases():
    section = None
    for line in (Path(__file__).parent.parent / "FIXTURES.md").read_text().split("\n"):
        if m := re.match(r"### (\w+) \(", line):
            section = NAMES.get(m[1])
        elif line.startswith("#"):
            section = None
        if section and (m := re.match(r"\| (\d+) \| (\w+) \| `(.*?)` \| (.*) \|$", line)) and "countries" not in m[2]:
            want = re.search(r"n=(\d)", m[4])
            if want:
                yield pytest.param(section, m[2], m[3].replace("\\n", "\n"), int(want[1]), re.findall(r"`(.*?)`", m[4]), id=f"{section}-{m[1]}")


@pytest.mark.parametrize("section,name,text,n,originals", list(cases()))
def test_lone_detectors(section, name, text, n, originals):
    if section == "ip":
        dets = [ONE["ip_address_v6"]] if "ipv6" in name else [ONE["ip_address_v4"], ONE["ip_address_v6"]] if "both" in name else [ONE["ip_address_v4"]]
    else:
        dets = [ONE[section]]
    got = [f for d in dets for f in K.detect_one(d, text)]
    assert len(got) == n
    assert {o for o in originals if o in text} <= {f.original for f in got}
    for f in got:
        assert text.encode()[f.start : f.end].decode() == f.original


@pytest.mark.parametrize("text,countries,n", [("DE: +49 30 12345678", ["DE"], 1), ("US local: 202-555-0123", [], 0), ("Intl: +12025550123", [], 1)])
def test_phone_countries(text, countries, n):
    (d,) = K.built_in(["phone_number"], countries)
    assert len(K.detect_one(d, text)) == n


ANCHORED = [
    ("Passport AB1234567", [], ["passport_number"]),
    ("my passport AB1234567", ["passport_number"], ["passport_number"]),
    ("4111111111111111", [], ["credit_card"]),
    ("card 4111111111111111", ["credit_card"], ["credit_card"]),
    ("SSN 123456789", [], ["ssn"]),
    ("id-1 123456789", ["ssn"], ["ssn"]),
    ("my passport 123456789 ok", ["passport_number"], ["ssn"]),
    ("live at 123 Main St", [], ["physical_address"]),
    ("street: 123 Main St", ["physical_address"], ["physical_address"]),
    ("x -123-45-6789", ["ssn"], ["ssn"]),
]


@pytest.mark.parametrize("text,original", [
    ("card 4328325728555127 " + "x" * 54 + "-", "4328325728555127"),  # the window of "-" begins within the number
    ("-" + "x" * 54 + " 4328325728555127 z", "4328325728555127"),  # and ends within it
    ("é" * 10 + " 4328325728555127 " + "x" * 54 + "-", "4328325728555127"),
    ("a" * 80 + "@b.org", "a" * 80 + "@b.org"),
])
def test_windows_cut_no_match(text, original):
    assert [f.original for f in K.detect(K.built_in(), text)] == [original] == [f.original for f in K.detect(K.built_in(), text, anchored=False)]


def test_redaction_covers_a_number_that_a_window_cuts():
    text = "card 4328325728555127 " + "x" * 54 + "-"
    assert K.redact(K.built_in(), Policy(), text).text == text.replace("432832572855", K.BLOCK * 12)
    assert K.TokenRedactor().redact(text, K.detect(K.built_in(), text)) == text.replace("4328325728555127", "[[CC_0]]")


def test_a_value_of_two_types_is_named_by_its_last_match():
    found = K.detect(K.built_in(), "Qui 208.98.142.209 du éch. 208.98.142.209 De")
    assert [f.pii_type for f in found] == ["phone_number", "ip_address_v4"]
    assert K.TokenRedactor().redact("Qui 208.98.142.209 du éch. 208.98.142.209 De", found) == "Qui [[PII_0]] du éch. [[PII_0]] De"


@pytest.mark.parametrize("text,got", [
    ("4328325728555127", ["4328325728555127"]),
    ("The\n4328325728555127.\n" + "x" * 70 + " y", ["4328325728555127"]),
    ("(202) 555-1974 4203211868239051 reo st", []),  # a street type without a word of addresses near it
    ("road (202) 555-1974 4203211868239051 reo st", ["1974 4203211868239051 reo st"]),
])
def test_gate_of_words(text, got):
    assert [f.original for f in K.detect(K.built_in(), text, anchored=K.WORDS)] == got


def test_windows_are_a_gate():
    det = K.Custom("code", r"\bX\d+\b", anchors=("key",))
    assert [f.start for f in K.detect([det], "X1" + " " * 80 + "X2 key X3" + " " * 80 + "X4")] == [82, 89]


@pytest.mark.parametrize("text,anchored,full", ANCHORED)
def test_anchors(text, anchored, full):
    nine = [d for d in K.built_in() if d.pii_type != "phone_number"]
    assert [f.pii_type for f in K.detect(nine, text)] == anchored
    assert [f.pii_type for f in K.detect(nine, text, anchored=False)] == full


@pytest.mark.parametrize(
    "text,want",
    [
        ("My SSN is 123-45-6789", "My SSN is ███-██-████"),
        ("Card: 4111 1111 1111 1111", "Card: ████ ████ ████ 1111"),
        ("4111 1111 1111 1111 1234", "4111 1111 1111 1111 1234"),
        ("Contact john.doe@example.com for support", "Contact ████.███@███████.com for support"),
        ("", ""),
        (" \t\n", " \t\n"),
    ],
)
def test_masks(text, want):
    assert K.redact(SIX, Policy(), text).text == want


def redact(text, policy, types=("email", "ssn")):
    return K.redact(K.built_in(list(types)), policy, text).text


def test_policies():
    p = Policy()
    assert redact("Email john@example.com, SSN 123-45-6789", p.disable("ssn")).endswith("SSN 123-45-6789")
    assert redact("Contact john@example.com", p.with_mode("replace")) == "Contact [REDACTED_EMAIL]"
    assert redact("Contact john@example.com", p.with_mode("replace").with_placeholder("email", "[MAIL]")) == "Contact [MAIL]"
    assert redact("a@b.com c@d.com e@f.com", p.with_mode("tokenize")) == "[[PII_0]] [[PII_1]] [[PII_2]]"
    assert redact("Contact john@example.com", p.with_mode("hash")).startswith("Contact [HASH:")
    assert redact("Mark this CONFIDENTIAL", p.with_blocklist(["CONFIDENTIAL"])) == "Mark this ████████████"
    assert redact("This document is CONFIDENTIALITY", p.with_blocklist(["CONFIDENTIAL"])) == "This document is CONFIDENTIALITY"
    assert redact("I like PINEAPPLE, APPLE pie", p.with_blocklist(["APPLE"]).with_allowlist(["APPLE"])) == "I like PINEAPPLE, APPLE pie"
    assert redact("TOP SECRET info: TOPSECRET is not matched", p.with_blocklist(["TOP", "SECRET"])) == "███ ██████ info: TOPSECRET is not matched"
    assert redact("Email support@example.com or john@example.com", p.with_allowlist(["support@example.com"])) == "Email support@example.com or ████@███████.com"
    assert redact("Email: john@example.com", p.with_blocklist(["example"])) == "Email: ████@███████.com███████.com"
    assert K.redact(K.built_in(["email"]), p.with_blocklist(["example"]), "Email: john@example.com", overlap="merge").text == "Email: ████@███████.com"


def test_profiles_and_settings(tmp_path):
    assert "ssn" not in Policy.gdpr().enabled and len(Policy.gdpr().enabled) == 9
    assert Policy.hipaa().allowlist == ("hospital", "clinic", "medical center")
    assert Policy.from_dict({}).enabled == frozenset()
    assert Policy.from_dict({"enabled_types": ["email", {"other": "PERSON"}]}).enabled == {"email"}
    p = Policy.gdpr().with_placeholder("email", "[MAIL]").with_mode("hash").with_blocklist(["x"])
    assert Policy.from_dict(p.to_dict()) == p
    with pytest.warns(UserWarning):
        q = Policy.from_settings({"enabled_types": ["phone", "nope"], "mode": "odd"})
    assert q.enabled == {"phone_number"} and q.mode == "mask"
    from cloakframe.policy import load_settings

    assert load_settings(str(tmp_path / "none.toml")) == {}


def test_custom_patterns():
    good, bad = K.custom_detectors([{"name": "emp", "pattern": r"EMP\d{6}", "confidence": "HIGH"}, {"name": "b", "pattern": "[bad"}])
    assert len(good) == 1 and good[0].confidence == "high" and "Invalid regex" in bad[0]
    assert [(f.start, f.end) for f in K.detect_one(good[0], "Badge number is: EMP123456")] == [(17, 26)]
    case = K.Custom("case", r"CASE-\d{4}-\d{4}", flags="i")
    assert len(K.detect_one(case, "case-2024-0001 and CASE-2024-0002")) == 2
    like = K.Custom("ssn_like", r"\d{3}-\d{2}-\d{4}")
    p = Policy().enable(like.pii_type).with_placeholder(like.pii_type, "[SSN]")
    assert K.redact([like], p, "SSN: 123-45-6789").text == "SSN: [SSN]"
    assert K.redact([like], Policy(), "SSN: 123-45-6789").text == "SSN: 123-45-6789"


def test_typed_tokens():
    r = K.TokenRedactor()
    found = K.detect(K.built_in(["email", "ssn"]), "a@b.com 123-45-6789 a@b.com")
    assert r.redact("a@b.com 123-45-6789 a@b.com", found) == "[[EMAIL_0]] [[SSN_1]] [[EMAIL_0]]"


def test_blake3_vectors():
    assert blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3_hex(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_properties_on_random_text():
    rnd = random.Random(11)
    alphabet = "ab1 -.@:+()É漢😀█/\n\t,49"
    for _ in range(3000):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        raw = t.encode()
        for anchored in (True, False):
            at = 0
            for f in K.detect(K.built_in(), t, anchored=anchored):
                assert at <= f.start < f.end <= len(raw) and raw[f.start : f.end].decode() == f.original
                at = f.end
        K.redact(K.built_in(), Policy().with_blocklist(["a", "1"]), t).text.encode()


def test_long_prose_is_no_trouble():
    K.detect(K.built_in(), "12 " + "word " * 20_000 + "street", anchored=False)
    K.detect(K.built_in(), "12 word " * 20_000, anchored=False)
