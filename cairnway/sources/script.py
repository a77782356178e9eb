"""Imports, exports and functions of one TypeScript or JavaScript file, read from its tokens.

One pass over the text keeps a stack of open brackets and templates.  It tells regular expressions from divisions by the token before, follows the
expressions inside template literals, and pairs brackets; declarations are then found by position among the tokens, jumping over what is
paired.  Every token is looked at a bounded number of times, so a file takes time in proportion to its length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

#: Tokens (fixed by the language): what is skipped, then a name, a number, a string, a mark of several characters or a single one, or the end.
TOKEN = re.compile(
    r"((?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))*)(?:([A-Za-z_$#][\w$]*)|(\d[\w.]*)|('(?:\\.|[^'\\\n])*'?|\"(?:\\.|[^\"\\\n])*\"?)|(=>|\?\.|\.\.\.|[=!]==?|&&|\|\||\?\?)|(.)|\Z)", re.S
)
REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
OPENS, CLOSES = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")
#: Words after which a slash starts a regular expression, words before a bracket that call nothing, and words before a member's name (fixed by the language).
BEFORE_REGEX = frozenset("return typeof case in of new delete void instanceof do else throw yield await".split())
NOT_CALLS = frozenset("if for while switch catch return function import typeof await new async super".split())
MODIFIERS = frozenset("public private protected static readonly override abstract declare async get set accessor".split())
DECLARES = frozenset("const let var".split())
#: Words that no type and no list of declarators goes on over, and words that no expression goes on over (fixed by the language).
STARTS = DECLARES | frozenset("function class export return if for while switch throw".split())
STATEMENTS = DECLARES | frozenset(["export"])
#: A line that starts or ends with one of these goes on.
GOES_ON = frozenset(". ?. ? : = => + - * / % & && | || ?? < > , ( [ { == === != !== ...".split())
NAME, NUMBER, STRING, MARK = "nxsm"
#: Kinds by the groups of ``TOKEN``, and words that imports are found by (fixed by the language).
KINDS = (None, None, NAME, NUMBER, STRING, MARK)
TELLING = frozenset(["import", "export", "require"])


class Tokens:
    """``text``, ``kind`` and ``start`` of the tokens; ``match``: the closing bracket of an opening one; ``depth``: open braces before a token."""

    def __init__(self, source: str):
        self.text, self.kind, self.start, self.depth = [], [], [], []
        self.match: dict[int, int] = {}
        self.ends = [m.start() for m in re.finditer("\n", source)]
        self._scan(source)
        self.opened = {last: first for first, last in self.match.items()}
        self.text += ["", "", ""]  # looking ahead is safe
        self.kind += [MARK] * 3
        self.start += [len(source)] * 3
        self.depth += [0] * 3
        self.size = len(self.text) - 3
        self.words = [i for i, x in enumerate(self.text) if x in TELLING]
        self.top = self._top()

    def _add(self, text: str, kind: str, at: int, depth: int) -> None:
        self.text.append(text)
        self.kind.append(kind)
        self.start.append(at)
        self.depth.append(depth)

    def _scan(self, source: str) -> None:
        at, depth, size, match = 0, 0, len(source), TOKEN.match
        texts, kinds, starts, depths = self.text, self.kind, self.start, self.depth
        open_: list[tuple[int, bool]] = []  # brackets by their token, and whether they stand in a template
        while at < size:
            m = match(source, at)
            group = m.lastindex
            if group == 1:  # nothing but what is skipped
                break
            text, at = m[group], m.start(group)
            if group < 6:
                texts.append(text)
                kinds.append(KINDS[group])
                starts.append(at)
                depths.append(depth)
                at = m.end()
                continue
            if text == "/" and self._regex_may_start("\n" in m[1]) and (found := REGEX.match(source, at)):
                self._add("''", STRING, at, depth)
                at = found.end()
                continue
            if text == "`":
                self._add("``", STRING, at, depth)
                at = self._template(source, at + 1, open_, depth)
                depth += len(open_) > 0 and open_[-1][1] and open_[-1][0] == len(texts) - 1
                continue
            closes = text in CLOSES
            depth -= closes and text == "}" and depth > 0
            texts.append(text)
            kinds.append(MARK)
            starts.append(at)
            depths.append(depth)
            at = m.end()
            if closes:
                if open_:
                    first, templated = open_.pop()
                    self.match[first] = len(texts) - 1
                    if templated and text == "}":
                        at = self._template(source, at, open_, depth)
                        depth += len(open_) > 0 and open_[-1][1] and open_[-1][0] == len(texts) - 1
            elif text in OPENS:
                open_.append((len(texts) - 1, False))
                depth += text == "{"

    def _template(self, source: str, at: int, open_: list[tuple[int, bool]], depth: int) -> int:
        """Goes on inside a template from ``at``: to its end, or into its next expression, which counts as braces."""
        at = TEMPLATE.match(source, at).end()
        if source.startswith("${", at):
            self._add("{", MARK, at, depth)
            open_.append((len(self.text) - 1, True))
            return at + 2
        return at + 1

    def _regex_may_start(self, on_new_line: bool) -> bool:
        if not self.text:
            return True
        text, kind = self.text[-1], self.kind[-1]
        if kind == NAME:
            return text in BEFORE_REGEX
        if kind != MARK or text in (")", "]", "<"):
            return False
        return text != "}" or on_new_line  # behind a block a new line starts a statement

    def line(self, i: int) -> int:
        return bisect_right(self.ends, self.start[i] - 1) + 1

    def new_line(self, i: int) -> bool:
        """Whether a token is the first of its line."""
        return i == 0 or self.line(i) > self.line(i - 1)

    def behind(self, i: int) -> int:
        """The token after ``i``, or after the bracket that closes it."""
        return self.match.get(i, self.size if self.text[i] in OPENS and self.kind[i] == MARK else i) + 1

    def _top(self) -> list[int]:
        """The tokens outside all braces."""
        out, i = [], 0
        while i < self.size:
            out.append(i)
            i = self.behind(i) if self.text[i] == "{" and self.kind[i] == MARK else i + 1
        return out

    def statement_end(self, i: int) -> int:
        """The last token of the expression or statement from ``i`` on."""
        last = i
        while i < self.size and self.text[i] not in (";", ",", ")", "]", "}") and (i == last or self.text[i] not in STATEMENTS):
            if i > last and self.new_line(i) and self.text[i] not in GOES_ON and self.text[last] not in GOES_ON:
                break
            last = self.behind(i) - 1
            i = last + 1
        return min(last, self.size - 1)

    def type_end(self, i: int) -> int:
        """The first token behind a type that starts at ``i``: an equals sign, a body's brace, or the end of the statement."""
        before = ":"
        while i < self.size:
            text = self.text[i]
            if text in ("=", ";", ",", ")", "]", "}") or text in STARTS or text == "{" and before not in (":", "|", "&", "=>", "<", ","):
                return i
            if before != ":" and self.new_line(i) and text not in GOES_ON and before not in GOES_ON:
                return i
            i = self.angle_end(i) if text == "<" else self.behind(i)
            before = self.text[i - 1]
        return i

    def angle_end(self, i: int) -> int:
        """The token behind the angle brackets that open at ``i``; they end with the statement at the latest."""
        depth = 0
        while i < self.size and self.text[i] not in (";", ")", "]", "}") and self.text[i] not in STARTS:
            depth += {"<": 1, ">": -1}.get(self.text[i], 0)
            i = self.behind(i)
            if not depth:
                break
        return i

    def body(self, i: int) -> tuple[int, int] | None:
        """First and last token of what a parameter list at ``i`` is for: the braces behind it and behind its result's type."""
        if self.text[i] == "<":
            i = self.angle_end(i)
        if self.text[i] != "(" or i not in self.match:
            return None
        i = self.behind(i)
        if self.text[i] == ":":
            i = self.type_end(i + 1)
        return (i, self.match.get(i, self.size - 1)) if self.text[i] == "{" else None

    def arrow(self, i: int) -> tuple[int, int] | None:
        """First and last token of the body, if a function expression or an arrow function starts at ``i``."""
        i += self.text[i] == "async"
        if self.text[i] == "function":
            i += 1 + (self.text[i + 1] == "*")
            return self.body(i + (self.kind[i] == NAME))
        if self.text[i] == "<":
            i = self.angle_end(i)
        if self.text[i] == "(":
            i = self.behind(i)
            if self.text[i] == ":":
                i = self._result_end(i + 1)
        elif self.kind[i] == NAME:
            i += 1
        if self.text[i] != "=>":
            return None
        i += 1
        return (i, self.match.get(i, self.size - 1) if self.text[i] == "{" else self.statement_end(i))

    def _result_end(self, i: int) -> int:
        """The arrow behind the result type that starts at ``i``."""
        while i < self.size and self.text[i] not in ("=>", "=", ";", ",", ")", "]", "}") and self.text[i] not in STARTS:
            i = self.angle_end(i) if self.text[i] == "<" else self.behind(i)
        return i

    def calls(self, first: int, last: int) -> list[str]:
        found = set()
        for i in range(first, last + 1):
            if self.text[i] == "(" and i > first and self.kind[i - 1] == NAME:
                chain, k = [self.text[i - 1]], i - 2
                while k > first and self.text[k] in (".", "?.") and self.kind[k - 1] == NAME:
                    chain.append(self.text[k - 1])
                    k -= 2
                found.add(".".join(reversed(chain)))
        return sorted(found - NOT_CALLS)


def listed(t: Tokens, first: int, last: int) -> Iterator[tuple[str, bool]]:
    """The names between two brackets, each one's original, and whether it is passed on as ``default``."""
    i = first
    while i < last:
        start = i
        while i < last and t.text[i] != ",":
            i = t.behind(i)
        at = start + (t.text[start] == "type" and t.kind[start + 1] == NAME and start + 1 < i and t.text[start + 1] != "as")
        if at < i and t.kind[at] == NAME:
            yield t.text[at], t.text[at + 1] == "as" and t.text[at + 2] == "default"
        i += 1


def plain_string(t: Tokens, i: int) -> str:
    return t.text[i][1:-1] if t.kind[i] == STRING and len(t.text[i]) > 2 and t.text[i][0] == t.text[i][-1] else ""


def imports(t: Tokens) -> Iterator[tuple[str, tuple[str, ...], bool]]:
    for i in t.words:
        word, names, source = t.text[i], set(), ""
        if t.kind[i] != NAME or i and t.text[i - 1] in (".", "?."):
            continue
        if word == "require" or word == "import" and t.text[i + 1] == "(":
            source = plain_string(t, i + 2) if t.text[i + 1] == "(" else ""
            k = i - 1 - (t.text[i - 1] == "await" if i else 0)
            if word == "require" and k > 0 and t.text[k] == "=":
                names = _assigned(t, k - 1)
        elif word == "import" and plain_string(t, i + 1):
            source = plain_string(t, i + 1)
        else:
            k = i + 1 + (t.text[i + 1] == "type" and t.text[i + 2] not in ("from", ","))
            while t.text[k] in ("*", ",", "{") or t.kind[k] == NAME and t.text[k] not in ("from", "import", "export") and (word == "import" or t.text[k - 1] == "as" or t.text[k] == "as"):
                if t.text[k] == "{":
                    names |= {n for n, _ in listed(t, k + 1, t.match.get(k, k))}
                elif t.text[k] == "*":
                    names.add("*")
                elif t.kind[k] == NAME and t.text[k] != "as" and t.text[k - 1] != "as":
                    names.add(t.text[k])
                k = t.behind(k)
            source = plain_string(t, k + 1) if t.text[k] == "from" else ""
        if source:
            yield source, tuple(sorted(names)), source[:1] in "./"


def _assigned(t: Tokens, last: int) -> set[str]:
    """The names of the declaration whose name or pattern ends at ``last``."""
    if t.kind[last] == NAME:
        return {t.text[last]} if last and t.text[last - 1] in (*DECLARES, ",") else set()
    first = t.opened.get(last, 0)
    return {n for n, _ in listed(t, first + 1, last)} if t.text[last] == "}" and first and t.text[first - 1] in (*DECLARES, ",") else set()


def declared(t: Tokens, i: int) -> Iterator[tuple[int, int]]:
    """The declarators from ``i`` on: the token of each plain name, and the first token of its value (0 if none)."""
    while i < t.size and t.text[i] not in STARTS:
        name = i
        i = t.behind(i)
        i += t.text[i] == "!"
        if t.text[i] == ":":
            i = t.type_end(i + 1)
        value = i + 1 if t.text[i] == "=" else 0
        if t.kind[name] == NAME:
            yield name, value
        if value:
            body = t.arrow(value)
            i = (body[1] if body else t.statement_end(value)) + 1
        if t.text[i] != ",":
            return
        i += 1


def exports(t: Tokens) -> Iterator[tuple[str, str, int]]:
    for i in t.top:
        if t.text[i] == "module" and t.new_line(i) and t.text[i + 1 : i + 4] == [".", "exports", "="]:
            if t.text[i + 4] != "{":
                yield "default", "default", t.line(i)
                continue
            k, last = i + 5, t.match.get(i + 4, t.size)
            while k < last:
                if t.kind[k] == NAME and t.text[k - 1] in ("{", ",") and t.text[k + 1] in (",", ":", "}"):
                    yield t.text[k], "variable", t.line(i)
                k = t.behind(k)
        if t.text[i] != "export" or t.kind[i] != NAME or i and t.text[i - 1] in (".", "?."):
            continue
        line, k = t.line(i), i + 1
        default = t.text[k] == "default"
        k += default
        k += t.text[k] == "declare"
        start, k = k, k + (t.text[k] in ("async", "abstract"))
        if t.text[k] in ("function", "class"):
            kind = t.text[k]
            k += 1 + (t.text[k + 1] == "*")
            if t.kind[k] == NAME and t.text[k] not in ("extends", "implements"):
                yield t.text[k], "default" if default else kind, line
            elif default:
                yield "default", "default", line
            continue
        k = start
        if default:
            if t.text[k] in ("interface", "enum") and t.kind[k + 1] == NAME:
                yield t.text[k + 1], "type", line
            else:
                yield "default", "default", line
        elif t.text[k] == "{":
            for name, as_default in listed(t, k + 1, t.match.get(k, k)):
                yield name, "default" if as_default else "variable", line
        elif t.text[k] == "const" and t.text[k + 1] == "enum":
            yield t.text[k + 2], "type", line
        elif t.text[k] in ("interface", "type", "enum") and t.kind[k + 1] == NAME:
            yield t.text[k + 1], "type", line
        elif t.text[k] in DECLARES:
            for name, _ in declared(t, k + 1):
                yield t.text[name], "variable", line


def functions(t: Tokens) -> Iterator[tuple[str, int, int, list[str]]]:
    def made(name: str, start: int, span: tuple[int, int]) -> tuple[str, int, int, list[str]]:
        return name, t.line(start), t.line(span[1]), t.calls(*span)

    for i in t.top:
        word = t.text[i]
        if t.kind[i] != NAME or i and t.text[i - 1] in (".", "?."):
            continue
        if word == "function":
            k = i + 1 + (t.text[i + 1] == "*")
            if t.kind[k] == NAME and (span := t.body(k + 1)):
                yield made(t.text[k], i - (i > 0 and t.text[i - 1] == "async"), span)
        elif word in DECLARES:
            for name, value in declared(t, i + 1):
                if value and (span := t.arrow(value)):
                    yield made(t.text[name], i if name == i + 1 else name, span)
        elif word == "class" and t.kind[i + 1] == NAME:
            k = i + 2
            while k < t.size and t.text[k] not in ("{", ";") and t.text[k] not in STARTS:
                k = t.angle_end(k) if t.text[k] == "<" else t.behind(k)
            if t.text[k] == "{":
                for name, start, span in members(t, k + 1, t.match.get(k, t.size)):
                    yield made(f"{t.text[i + 1]}.{name}", start, span)


def members(t: Tokens, i: int, last: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """``name, token, body`` of the methods and of the fields that hold functions between a class's braces."""
    while i < last:
        while t.text[i] in MODIFIERS and (t.kind[i + 1] == NAME or t.text[i + 1] in ("*", "[")) and not (t.new_line(i + 1) and t.text[i] in ("get", "set", "static")):
            i += 1
        i += t.text[i] == "*"
        name, k = i, i + 1
        span = None
        if t.kind[name] == NAME:
            k += t.text[k] in ("?", "!")
            if t.text[k] in ("(", "<"):
                span = t.body(k)
            else:
                if t.text[k] == ":":
                    k = t.type_end(k + 1)
                span = t.arrow(k + 1) if t.text[k] == "=" else None
            if span and t.text[name] not in NOT_CALLS:
                yield t.text[name], name, span
        i = span[1] + 1 if span else max(t.statement_end(i) + 1, i + 1)
        while t.text[i] in (";", ",") and i < last:
            i += 1


def read_script(text: str) -> dict:
    t = Tokens(text)
    return {
        "imports": list(dict.fromkeys(imports(t))), "exports": list(dict.fromkeys(exports(t))), "functions": sorted(functions(t), key=lambda f: (f[1], f[0])), "has_guard": False,
    }
