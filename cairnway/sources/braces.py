"""Imports, exports and functions of one Go file: comments and strings are blanked, braces give extents.

Positions in the blanked text are those of the file.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

NAME = r"[A-Za-z_$][\w$]*"
#: Comments and strings (fixed by the language).
LITERALS = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`", re.S)
#: Words before a bracket that call nothing (fixed by the language).
NOT_CALLS = frozenset("if for switch return func go defer select range".split())
CALL = re.compile(rf"({NAME}(?:\s*\??\.\s*{NAME})*)\s*\(")
INK, INKED, MARKS = re.compile(r"\S"), re.compile(r"[^\n]"), re.compile(r"[{}();\n]")

GO_IMPORTS = re.compile(r"(?m)^[ \t]*import\b([ \t]*\()?")
GO_IMPORT = re.compile(r"(?:([\w.]+)[ \t]+)?\"([^\"\n]+)\"")
GO_FUNCTION = re.compile(r"(?m)^func\s+(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)\n]*\)\s*)?(\w+)\s*[(\[]")
GO_GROUP = re.compile(r"(?m)^(type|const|var)\s*(\()?")
GO_STARTS, GO_MAIN, BLANK = re.compile(r"[\n;(]"), re.compile(r"(?m)^package\s+main\b"), re.compile(r"\s|\?")
GO_NAMES = re.compile(r"\s*(\w+(?:\s*,\s*\w+)*)(\s*(?:\[[^\]]*\]\s*)?=?\s*struct\b)?")


class Text:
    """A file, its blanked text, and where its braces and brackets close."""

    def __init__(self, text: str):
        clean, code, at = [], [], 0
        for m in LITERALS.finditer(text):
            found = m[0]
            blank = " " * len(found) if "\n" not in found else INKED.sub(" ", found)
            clean += (text[at : m.start()], blank)
            code += (text[at : m.start()], blank if found[0] == "/" else found)
            at = m.end()
        #: Comments are blank in both, strings in the first.
        self.clean, self.code = "".join([*clean, text[at:]]), "".join([*code, text[at:]])
        self.ends, self.opens, self.shuts, self.stops, self.close, stack = [], [], [], [], {}, []
        for m in MARKS.finditer(self.clean):
            at, mark = m.start(), m[0]
            if mark == "\n":
                self.ends.append(at + 1)
                self.stops.append(at)
            elif mark == ";":
                self.stops.append(at)
            elif mark in "{(":
                stack.append(at)
                if mark == "{":
                    self.opens.append(at)
            else:
                if stack:
                    self.close[stack.pop()] = at
                if mark == "}":
                    self.shuts.append(at)
        self.functions = list(GO_FUNCTION.finditer(self.clean))

    def depth(self, at: int) -> int:
        """Open braces before a position."""
        return bisect_left(self.opens, at) - bisect_left(self.shuts, at)

    def line(self, at: int) -> int:
        return bisect_right(self.ends, at) + 1

    def body_end(self, at: int) -> int:
        """The last position of what begins at ``at``: its closing brace, or the end of its statement."""
        i = bisect_left(self.opens, at)
        start = self.opens[i] if i < len(self.opens) else -1
        k = bisect_left(self.stops, at)
        stop = self.stops[k] if k < len(self.stops) else None
        first = INK.search(self.clean, at, max(start, at))
        if start >= 0 and not (stop is not None and stop < start and first and first[0] != ":"):
            return self.close.get(start, len(self.clean) - 1)
        return stop if stop is not None else len(self.clean) - 1

    def calls(self, start: int, end: int) -> list[str]:
        found = {BLANK.sub("", m[1]) for m in CALL.finditer(self.clean, start, end + 1)}
        return sorted(c for c in found if c not in NOT_CALLS)

    def function(self, name: str, start: int, body: int) -> tuple[str, int, int, list[str]]:
        end = self.body_end(body)
        return name, self.line(start), self.line(end), self.calls(body, end)


def go_imports(t: Text) -> Iterator[tuple[str, tuple[str, ...], bool]]:
    for m in GO_IMPORTS.finditer(t.clean):
        line_end = t.clean.find("\n", m.end())
        stop = t.close.get(m.end() - 1, len(t.clean)) if m[1] else line_end if line_end >= 0 else len(t.clean)
        for x in GO_IMPORT.finditer(t.code, m.end(), stop):
            yield x[2], (x[1],) if x[1] else (), False


def go_exports(t: Text) -> Iterator[tuple[str, str, int]]:
    upper = lambda name: name[:1].isupper()
    for m in t.functions:
        if upper(m[2]):
            yield f"{m[1]}.{m[2]}" if m[1] else m[2], "function", t.line(m.start())
    for m in GO_GROUP.finditer(t.clean):
        stop = t.close.get(m.start(2), len(t.clean)) if m[2] else m.end() + 1
        starts = [m.end()] if not m[2] else [x.end() for x in GO_STARTS.finditer(t.clean, m.start(2), stop) if not t.depth(x.end())]
        for at in starts:
            x = GO_NAMES.match(t.clean, at)
            for name in re.findall(r"\w+", x[1]) if x and x.start(1) < max(stop, at + 1 if not m[2] else stop) else []:
                if upper(name):
                    yield name, {"type": "class" if x[2] else "type"}.get(m[1], "variable"), t.line(x.start(1))


def read_go(text: str) -> dict:
    t = Text(text)
    functions = []
    for m in t.functions:
        functions.append(t.function(f"{m[1]}.{m[2]}" if m[1] else m[2], m.start(), t.close.get(m.end() - 1, m.end())))
    starts = GO_MAIN.search(t.clean) and any(f[0] == "main" for f in functions)
    return {"imports": list(dict.fromkeys(go_imports(t))), "exports": list(dict.fromkeys(go_exports(t))), "functions": functions, "has_guard": bool(starts)}
