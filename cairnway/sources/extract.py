"""Imports, exports and functions of source files, one small helper a file in Arrow batches.

Python files go through the standard parser, scripts through the tokens of ``script``, Go through the scanner of ``braces``.  ``LANGUAGES`` says which table
function reads a language; ``register`` adds another with its suffixes.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame

from cairnway.sources import tree
from cairnway.sources.braces import read_go
from cairnway.sources.script import read_script

SHAPE = (
    "imports array<struct<source:string,specifiers:array<string>,is_relative:boolean>>, exports array<struct<name:string,kind:string,line:int>>, "
    "functions array<struct<name:string,line:int,end_line:int,calls:array<string>>>, nesting int, has_guard boolean, has_side_effects boolean"
)
#: Statements that do nothing when a module is loaded, and syntax nodes that add a level of nesting (fixed values).
PASSIVE = (ast.Import, ast.ImportFrom, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Assign, ast.AnnAssign, ast.TypeAlias)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
BLOCKS = frozenset([
    *DEFS, ast.ClassDef, ast.For, ast.AsyncFor, ast.While, ast.If, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.ExceptHandler, ast.Match, ast.match_case,
])
#: All kinds of syntax nodes, those that may hold statements, those with nothing of interest below, and the fields of each kind that may hold nodes.
NODES = [x for x in vars(ast).values() if isinstance(x, type) and issubclass(x, ast.AST)]
HOLDS = BLOCKS | {x for x in NODES if issubclass(x, ast.stmt)}
PLAIN = frozenset([type(None), str, bytes, int, float, complex, bool, type(...), ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal])
FIELDS = {x: tuple(f for f in x._fields if f not in ("ctx", "op", "ops", "id", "attr", "type_comment")) for x in NODES}


def _called(node: ast.expr) -> str | None:
    """The dotted name of what is called; a receiver without a name is left out."""
    tail = []
    while isinstance(node, ast.Attribute):
        tail.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        tail.append(node.id)
    return ".".join(reversed(tail)) or None


def _outline(tree: ast.Module) -> tuple[list, list, int]:
    """Imports; functions under their qualified names, with sorted calls (those below other statements are not looked for); how deep blocks are nested."""
    imports, functions, deepest = [], [], 0
    stack = [(tree, 0, "", ())]  # a node, the blocks around it, its prefix if functions count right below it, and the calls of the functions around it
    while stack:
        node, depth, prefix, around = stack.pop()
        for field in FIELDS[node.__class__]:
            value = getattr(node, field, None)
            for child in value if value.__class__ is list else (value,):
                kind = child.__class__
                if kind in PLAIN or not around and kind not in HOLDS:
                    continue
                if kind is ast.Import:
                    imports += [(a.name, [], False) for a in child.names]
                    continue
                if kind is ast.ImportFrom:
                    imports.append(("." * child.level + (child.module or ""), sorted([a.name for a in child.names]), child.level > 0))
                    continue
                if kind is ast.Call and (name := _called(child.func)):
                    for calls in around:
                        calls.add(name)
                below, own, inner = depth, None, around
                if kind in BLOCKS:
                    below += 1
                    deepest = max(deepest, below)
                    if prefix is not None and (kind in DEFS or kind is ast.ClassDef):
                        own = f"{prefix}{child.name}."
                        if kind in DEFS:
                            inner = (*around, set())
                            functions.append((own[:-1], child.lineno, child.end_lineno, inner[-1]))
                stack.append((child, below, own, inner))
    return imports, sorted([(*f[:3], sorted(f[3])) for f in functions], key=lambda f: (f[1], f[0])), deepest


def _is_guard(node: ast.stmt) -> bool:
    """``if __name__ == "__main__"``, either way round."""
    test = node.test if isinstance(node, ast.If) else None
    if not isinstance(test, ast.Compare) or len(test.ops) != 1 or not isinstance(test.ops[0], ast.Eq):
        return False
    sides = [test.left, *test.comparators]
    return any(isinstance(x, ast.Name) and x.id == "__name__" for x in sides) and any(isinstance(x, ast.Constant) and x.value == "__main__" for x in sides)


def _acts(node: ast.stmt) -> bool:
    literal = isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant)
    return not literal and not isinstance(node, PASSIVE)


def parse_python(content: bytes) -> dict | None:
    """The rows of one file; None if it does not parse."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    (imports, functions, nesting), exports, listed = _outline(tree), [], None
    for node in tree.body:
        if isinstance(node, DEFS):
            exports.append((node.name, "function", node.lineno))
        elif isinstance(node, ast.ClassDef):
            exports.append((node.name, "class", node.lineno))
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    exports.append((target.id, "variable", node.lineno))
                    if target.id == "__all__" and isinstance(node.value, ast.List | ast.Tuple):
                        listed = {e.value for e in node.value.elts if isinstance(e, ast.Constant)}
    exports = [e for e in exports if (e[0] in listed if listed is not None else not e[0].startswith("_"))]
    return {
        "imports": sorted(imports), "exports": sorted(exports, key=lambda e: (e[2], e[0])), "functions": functions, "nesting": nesting,
        "has_guard": any(map(_is_guard, tree.body)), "has_side_effects": any(map(_acts, tree.body)),
    }


NONE = {"imports": [], "exports": [], "functions": [], "nesting": 0, "has_guard": False, "has_side_effects": False}


TEXTS = pa.list_(pa.string())
#: The columns of ``SHAPE`` as Arrow sees them; those that hold rows by their fields.
ROWS = {
    "imports": [("source", pa.string()), ("specifiers", TEXTS), ("is_relative", pa.bool_())], "exports": [("name", pa.string()), ("kind", pa.string()), ("line", pa.int32())],
    "functions": [("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("calls", TEXTS)],
}
VALUES = {"nesting": pa.int32(), "has_guard": pa.bool_(), "has_side_effects": pa.bool_()}


def _nested(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Lists of tuples as an array of lists of structs."""
    starts = [0, *accumulate(map(len, rows))]
    columns = list(zip(*chain.from_iterable(rows), strict=True)) or [()] * len(fields)
    made = [pa.array(column, kind) for column, (_, kind) in zip(columns, fields, strict=True)]
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays(made, [name for name, _ in fields]))


def _read(files: DataFrame, parse: Callable[[bytes], dict | None]) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [NONE | (parse(content) or {}) for content in batch.column("content").to_pylist()]
            columns = [_nested([x[name] for x in found], fields) for name, fields in ROWS.items()]
            columns += [pa.array([x[name] for x in found], kind) for name, kind in VALUES.items()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], names=["path", *ROWS, *VALUES])

    return files.select("path", "content").mapInArrow(rows, f"path string, {SHAPE}")


def extract_python(files: DataFrame) -> DataFrame:
    """``files(path, content)`` with imports, exports, functions, nesting and the program guard; broken files get empty lists."""
    return _read(files, parse_python)


def extract_script(files: DataFrame) -> DataFrame:
    """As ``extract_python``, of TypeScript and JavaScript; a file's name tells whether it starts a program (``order.is_script_entry``)."""
    return _read(files, lambda content: read_script(content.decode("utf-8", "replace")))


def extract_go(files: DataFrame) -> DataFrame:
    """As ``extract_python``, of Go; ``has_guard``: a main function in package main."""
    return _read(files, lambda content: read_go(content.decode("utf-8", "replace")))


#: Table functions from ``files(path, content)`` to ``path`` and the columns of ``SHAPE``.
LANGUAGES: dict[str, Callable[[DataFrame], DataFrame]] = {"python": extract_python, "script": extract_script, "go": extract_go}


def register(language: str, suffixes: list[str], reader: Callable[[DataFrame], DataFrame]) -> None:
    """Add a language; a name and a suffix can be taken once, and a suffix begins with a dot."""
    taken = {x for ends in tree.LANGUAGES.values() for x in ends.split()}
    if language in LANGUAGES or not suffixes or any(not x.startswith(".") or x in taken for x in suffixes):
        raise ValueError(f"{language} {' '.join(suffixes)}: a name or suffix is taken, or has no dot")
    LANGUAGES[language] = reader
    tree.LANGUAGES[language] = " ".join(suffixes)
