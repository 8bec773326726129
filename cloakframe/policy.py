"""Redaction policies: what is looked for, what is spared, how matches are replaced."""

from __future__ import annotations

import tomllib
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from types import MappingProxyType

from cloakframe.types import ALIASES, BUILT_IN, info, type_from_config, type_to_config

MODES = ("mask", "replace", "hash", "tokenize")


@dataclass(frozen=True)
class Policy:
    """Immutable; the fluent methods return changed copies. The default looks for all built-in types and masks them."""

    enabled: frozenset[str] = frozenset(BUILT_IN)
    placeholders: MappingProxyType = field(default_factory=lambda: MappingProxyType({}))
    mode: str = "mask"
    allowlist: tuple[str, ...] = ()
    blocklist: tuple[str, ...] = ()
    strict: bool = True

    def __reduce__(self):
        return _restore, (self.enabled, dict(self.placeholders), self.mode, self.allowlist, self.blocklist, self.strict)

    def enable(self, *types: str) -> Policy:
        return replace(self, enabled=self.enabled | set(types))

    def disable(self, *types: str) -> Policy:
        return replace(self, enabled=self.enabled - set(types))

    def with_placeholder(self, pii_type: str, text: str) -> Policy:
        return replace(self, placeholders=MappingProxyType({**self.placeholders, pii_type: text}))

    def with_mode(self, mode: str) -> Policy:
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
        return replace(self, mode=mode)

    def with_allowlist(self, terms: Iterable[str]) -> Policy:
        return replace(self, allowlist=tuple(terms))

    def with_blocklist(self, terms: Iterable[str]) -> Policy:
        return replace(self, blocklist=tuple(terms))

    def strict_validation(self, on: bool) -> Policy:
        return replace(self, strict=on)

    def is_enabled(self, pii_type: str) -> bool:
        return pii_type in self.enabled

    def placeholder_for(self, pii_type: str) -> str:
        return self.placeholders.get(pii_type, info(pii_type).placeholder)

    def custom_placeholder(self, pii_type: str) -> str | None:
        return self.placeholders.get(pii_type)

    def is_allowed(self, text: str) -> bool:
        return any(t in text for t in self.allowlist)

    def is_blocked(self, text: str) -> bool:
        return any(t in text for t in self.blocklist)

    @classmethod
    def gdpr(cls) -> Policy:
        return cls().disable("ssn")

    @classmethod
    def hipaa(cls) -> Policy:
        return cls().with_allowlist(("hospital", "clinic", "medical center"))

    @classmethod
    def pci_dss(cls) -> Policy:
        return cls().strict_validation(True)

    def to_dict(self) -> dict:
        return {
            "enabled_types": [type_to_config(t) for t in sorted(self.enabled)],
            "placeholders": [[type_to_config(k), v] for k, v in sorted(self.placeholders.items())],
            "mode": self.mode,
            "allowlist": list(self.allowlist),
            "blocklist": list(self.blocklist),
            "strict_validation": self.strict,
        }

    @classmethod
    def from_dict(cls, config: dict) -> Policy:
        """An absent list is empty, so {} looks for nothing. Custom types don't come back."""
        mode = config.get("mode", "mask")
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
        pairs = config.get("placeholders", [])
        pairs = pairs.items() if isinstance(pairs, dict) else pairs
        return cls(
            enabled=frozenset(t for t in map(type_from_config, config.get("enabled_types", [])) if t),
            placeholders=MappingProxyType({t: v for k, v in pairs if (t := type_from_config(k))}),
            mode=mode,
            allowlist=tuple(config.get("allowlist", ())),
            blocklist=tuple(config.get("blocklist", ())),
            strict=config.get("strict_validation", True),
        )

    @classmethod
    def from_settings(cls, section: dict | None, honour_mode: bool = True) -> Policy:
        """The policy section of a configuration file: names by any alias; a list of types replaces the default set."""
        p, section = cls(), section or {}
        if names := section.get("enabled_types"):
            known = [ALIASES.get(n) for n in names]
            for n, t in zip(names, known, strict=True):
                if t is None:
                    warnings.warn(f"unknown type {n!r} is left out", stacklevel=2)
            p = replace(p, enabled=frozenset(t for t in known if t))
        p = p.with_allowlist(section.get("allowlist", ())).with_blocklist(section.get("blocklist", ()))
        mode = section.get("mode")
        if honour_mode and mode:
            if mode in MODES:
                p = p.with_mode(mode)
            else:
                warnings.warn(f"unknown mode {mode!r}; matches are masked", stacklevel=2)
        return p


def _restore(enabled, placeholders, mode, allowlist, blocklist, strict) -> Policy:
    return Policy(enabled, MappingProxyType(placeholders), mode, allowlist, blocklist, strict)


def load_settings(path: str) -> dict:
    """A TOML file as a dict; a missing file is an empty one, a broken one raises."""
    try:
        with open(path, "rb") as f:
            return tomllib.load(f)
    except FileNotFoundError:
        return {}
