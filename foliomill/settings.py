"""Settings with their defaults, bounds and spellings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields


def names(value: object) -> list[str]:
    """A list, or a text cut at ; , and line ends; blank entries are dropped."""
    parts = value if isinstance(value, (list, tuple)) else re.split(r"[;,\n]", str(value or ""))
    return [p for p in (str(x).strip() for x in parts) if p]


def secrets(value: object) -> list[str]:
    """As names, but a comma may be part of a secret."""
    parts = value if isinstance(value, (list, tuple)) else re.split(r"[;\n]", str(value or ""))
    return [p for p in (str(x).strip() for x in parts) if p]


def credential(value: str) -> dict[str, str]:
    """'access:secret' as its two keys; the secret may hold colons. A text without one is a token."""
    a, colon, b = value.partition(":")
    return {"accessKey": a, "secretKey": b} if colon else {"token": value}


@dataclass
class Settings:
    pdf_backends: list[str] = field(default_factory=lambda: ["local"])
    split_pages: int = 180
    max_rows: int = 100
    max_cols: int = 50
    include_media: bool = True
    block_bytes: int = 28 * 1024
    block_count: int = 4
    max_remote_media: int = 100
    retries: int = 3
    base_delay_ms: int = 1000
    tokens: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, raw: dict | None) -> Settings:
        """From a flat dict; unknown keys are ignored, other types than dict are no settings."""
        raw = raw if isinstance(raw, dict) else {}
        known = {f.name for f in fields(cls)}
        out = cls(**{k: v for k, v in raw.items() if k in known and v is not None})
        out.pdf_backends, out.tokens = names(out.pdf_backends), secrets(out.tokens)
        if out.max_rows < 0 or out.max_cols < 0:
            raise ValueError("a limit must not be negative")
        return out
