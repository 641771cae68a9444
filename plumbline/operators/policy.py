"""Policy: rules, thresholds and exemptions, loaded from YAML or built in code.

A policy is small and known to the driver, so ruling turns it into expressions; no table of
rules is joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from plumbline.functions.kinds import BLOCK, KINDS, SENSITIVE_TAGS, SEVERITIES, WARN


class PolicyError(ValueError):
    """A policy that can't be loaded or would behave surprisingly."""


@dataclass(frozen=True)
class Thresholds:
    """A change up to and including a threshold is silent."""

    null_rate_jump_pp: float = 10.0
    cardinality_change_pct: float = 50.0
    mean_shift_sigma: float = 3.0
    row_count_change_pct: float = 50.0


@dataclass(frozen=True)
class Exemption:
    """An accepted risk: criteria that are not set match anything; expired ones match nothing."""

    reason: str
    expires: datetime | None = None
    downgrade_to: str = WARN
    kind: str | None = None
    urn_pattern: str | None = None
    column: str | None = None

    def active(self, now: datetime) -> bool:
        return self.expires is None or now < self.expires


@dataclass(frozen=True)
class Policy:
    rules: dict[str, str] = field(default_factory=dict)
    thresholds: Thresholds = Thresholds()
    exemptions: tuple[Exemption, ...] = ()
    sensitive_tags: tuple[str, ...] = SENSITIVE_TAGS
    allow_probable_block: bool = False
    max_hops: int = 5
    fail_on_truncation: bool = False
    models: tuple[str, ...] = ()

    def severity_of(self, kind: str) -> str:
        return self.rules.get(kind, KINDS[kind][1])

    def validate(self) -> Policy:
        """Raises PolicyError on unknown kinds, exemptions without expiry and exemptions to BLOCK."""
        if unknown := sorted(set(self.rules) - set(KINDS)):
            raise PolicyError(f"unknown finding kinds {unknown}; there are {sorted(KINDS)}")
        for x in self.exemptions:
            if x.expires is None:
                raise PolicyError(f"the exemption {x.reason!r} never expires")
            if x.downgrade_to == BLOCK:
                raise PolicyError(f"the exemption {x.reason!r} downgrades to BLOCK")
        return self

    def table(self) -> list[tuple[str, str, str, str]]:
        """(kind, severity, confidence, source) of every kind, as it takes effect."""
        return [(k, self.severity_of(k), c, "policy" if k in self.rules else "default") for k, (c, _) in KINDS.items()]


def _instant(value) -> datetime | None:
    if value is None or isinstance(value, datetime):
        out = value
    elif hasattr(value, "year"):
        out = datetime(value.year, value.month, value.day)
    else:
        out = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    return out.replace(tzinfo=UTC) if out is not None and out.tzinfo is None else out


def _severity(value: str) -> str:
    if value not in SEVERITIES:
        raise PolicyError(f"no such severity: {value!r}")
    return value


def policy_from(document: dict) -> Policy:
    """A policy from a parsed document; absent fields keep their defaults."""
    try:
        exemptions = tuple(
            Exemption(
                reason=x["reason"],
                expires=_instant(x.get("expires")),
                downgrade_to=_severity(x.get("downgrade_to", WARN)),
                kind=x.get("kind"),
                urn_pattern=x.get("urn_pattern"),
                column=x.get("column"),
            )
            for x in document.get("exemptions") or ()
        )
        known = {k: document[k] for k in ("allow_probable_block", "max_hops", "fail_on_truncation") if k in document}
        return Policy(
            rules={k: _severity(v) for k, v in (document.get("rules") or {}).items()},
            thresholds=Thresholds(**(document.get("thresholds") or {})),
            exemptions=exemptions,
            sensitive_tags=tuple(document.get("sensitive_tags") or SENSITIVE_TAGS),
            models=tuple(document.get("models") or ()),
            **known,
        )
    except (KeyError, TypeError, AttributeError, ValueError) as e:
        raise PolicyError(f"malformed policy: {e}") from e


def load_policy(path: str | Path) -> Policy:
    """The policy in a YAML file; the defaults where there is no such file."""
    import yaml

    path = Path(path)
    if not path.exists():
        return Policy()
    try:
        document = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    except yaml.YAMLError as e:
        raise PolicyError(f"malformed policy: {e}") from e
    if not isinstance(document, dict):
        raise PolicyError("malformed policy: no mapping")
    return policy_from(document)
