"""Names of working columns that no input column has."""

from __future__ import annotations


def unused(taken: list[str], *names: str) -> list[str]:
    """Each name, with as many leading underscores more as it takes to clash with none of ``taken`` (case aside)."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out
