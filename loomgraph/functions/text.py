"""Column expressions and argument checks that several operators use."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: fixed values: extension and language
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".java": "java"}


def fold(c: Column | str) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(c, UPPER, LOWER)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def lang_from_path(path: str) -> str | None:
    return next((lang for end, lang in LANGUAGES.items() if path.endswith(end)), None)


def language(path: Column | str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    out = F.lit(None).cast("string")
    for end, lang in LANGUAGES.items():
        out = F.when(c.endswith(end), lang).otherwise(out)
    return out


def extension(path: Column | str) -> Column:
    """Text from the last dot on; empty without one."""
    return F.regexp_extract(path, r"(\.[^.]*)$", 1)


def language_label(path: Column | str) -> Column:
    """Extension without its dot, for the known languages; `other` for the rest."""
    e = extension(path)
    return F.when(e.isin(*LANGUAGES), F.substring(e, 2, 10)).otherwise("other")


def base_name(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def is_test_file(path: Column | str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return c.contains("test_") | c.contains("tests/") | base_name(c).startswith("test_") | c.endswith("_test.py")


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count two."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def token_cost(c: Column | str) -> Column:
    return (F.ceil(utf16_length(c) / 4) + 1).cast("long")


def symbol_line(file: str = "file", line: str = "line", kind: str = "kind", name: str = "name", signature: str = "signature") -> Column:
    """`file:line  kind  name[  signature]`."""
    return F.concat_ws("  ", F.concat(F.col(file), F.lit(":"), F.col(line).cast("string")), F.col(kind), F.col(name), F.col(signature))


def is_file_target(target: str) -> bool:
    return target.endswith(tuple(LANGUAGES)) or "/" in target or "\\" in target


def clamp_depth(depth: float | None = 2) -> float:
    """0 to 5; two by default."""
    return max(0, min(2 if depth is None else depth, 5))


def _finite(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def resolve_depth(depth) -> int:
    """A tool's depth: whole, 1 to 5; two if it is no number."""
    return max(1, min(math.floor(depth), 5)) if _finite(depth) else 2


def resolve_top_k(top_k) -> int:
    return max(1, math.floor(top_k)) if _finite(top_k) else 20


def resolve_budget(budget) -> int:
    return max(200, min(math.floor(budget), 8000)) if _finite(budget) else 1500


def ordered(c: Column | str, collation: str | None = None) -> Column:
    """The column as a sort key: by bytes, or by a named collation such as UNICODE."""
    c = F.col(c) if isinstance(c, str) else c
    return F.collate(c, collation) if collation else c
