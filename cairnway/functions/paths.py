"""Column functions over paths, hashes and text lines (built-in expressions only)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def below_root(path: Column, root: Column | str) -> Column:
    """A path relative to the root it lies under, else null; ``/repo2`` does not lie under ``/repo``."""
    start = F.concat(F.regexp_replace(F.lit(root) if isinstance(root, str) else root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, start), F.substr(path, F.char_length(start) + 1))


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r".(\.[^.]*)$", 1)


def short_hash(content: Column) -> Column:
    """The first 8 hex digits of the SHA-256 of a content."""
    return F.substring(F.sha2(content, 256), 1, 8)


def bracket(body: str) -> str:
    """The inside of a glob's brackets as a character class."""
    body = body.replace("\\", "\\\\").replace("[", "\\[")
    return "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored regular expression: ``*`` crosses ``/``, ``[!`` negates."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            out += bracket(glob[i + 1 : end])
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def is_test(path: Column) -> Column:
    """Test files by name: conftest, ``test``, ``test_*`` or ``*_test``."""
    return (basename(path) == "conftest.py") | stem(path).rlike("^(test|test_.*|.*_test)$")


def tested_stem(path: Column) -> Column:
    """The stem that a test file is for."""
    return F.regexp_replace(F.regexp_replace(stem(path), "^test_", ""), "_test$", "")


def in_utility_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(dirname(path), "/"), F.array(*[F.lit(d) for d in ("utils", "helpers", "lib")]))


#: What ends a line, and white space, as a language with Unicode texts sees them (fixed values).
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def code_lines(text: Column) -> Column:
    """Lines that are neither blank nor comments: their first character that is not white space is no ``#``."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), LINE_ENDS), lambda x: x.rlike(f"^[{BLANKS}]*[^{BLANKS}#]")))


def half_even_percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(part * 100.0, whole)), F.lit(0.0)).cast("long")


def half_up_percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole)), F.lit(0.0)).cast("long")


NAMED = r"(\w+)"
#: What a line may declare, in the order that decides between two declarations: script functions, arrow functions and classes anywhere on it, Python's at its start.
DECLARING = (
    rf"\bfunction\s+{NAMED}",
    rf"\b(?:let|const|var)\s+{NAMED}\s*=\s*(?:async\s+)?(?:[^=]|\([^)]*\))\s*=>",
    rf"\bclass\s+{NAMED}",
    rf"^\s*(?:async\s+)?def\s+{NAMED}\s*\(",
)


def declared_name(line: Column) -> Column:
    """The name that a line declares, null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in DECLARING])
