"""Column names that do not clash with those of the input."""

from __future__ import annotations


def free(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as no column of ``taken`` has (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def kept_names(columns: list[str], results: list[str]) -> dict[str, str]:
    """Input column -> its name in the result: its own, or with ``input_`` before it where a result column has that."""
    reserved, out = {c.lower() for c in results}, {}
    for c in columns:
        out[c] = c if c.lower() not in reserved else free([*columns, *results], f"input_{c}")[0]
    return out
