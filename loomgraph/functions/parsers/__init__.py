"""Front ends: source text to symbols, imports and calls."""

from __future__ import annotations

from loomgraph.functions.parsers.golang import parse_go
from loomgraph.functions.parsers.java import parse_java
from loomgraph.functions.parsers.python import parse_python
from loomgraph.functions.parsers.typescript import parse_typescript

PARSERS = {
    "python": parse_python,
    "typescript": parse_typescript,
    "tsx": lambda source: parse_typescript(source, tsx=True),
    "go": parse_go,
    "java": parse_java,
}


def analyze(source: str | None, lang: str = "python") -> dict:
    """symbols [(name, kind, line, signature)], imports [ref], calls [(caller, callee)], in order."""
    if lang not in PARSERS:
        raise ValueError(f"unknown language: {lang}")
    return PARSERS[lang](source or "")


def extract_symbols(source: str | None) -> list[tuple[str, str, int, str]]:
    return analyze(source)["symbols"]
