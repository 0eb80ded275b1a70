"""Finding the column a user means."""

from __future__ import annotations

import re


def _squeezed(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def resolve_column(name: str, columns: list[str]) -> str | None:
    """Exact name, else ignoring case, else ignoring all but letters and digits."""
    token = str(name or "").strip()
    if not token:
        return None
    for fold in (str, str.lower, _squeezed):
        wanted = fold(token)
        hit = next((c for c in columns if wanted and fold(c) == wanted), None)
        if hit:
            return hit
    return None


def columns_in_text(text: str, columns: list[str]) -> list[str]:
    """Columns mentioned as whole words; underscores may be read as blanks."""
    source = str(text or "").lower()
    found = []
    for c in columns:
        spellings = {c.lower(), re.sub(r"[_-]", " ", c.lower())}
        if any(s and re.search(rf"(?<![a-z0-9_]){re.escape(s)}(?![a-z0-9_])", source) for s in spellings):
            found.append(c)
    return found
