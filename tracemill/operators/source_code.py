"""Jobs over files of source code: selection, one row a function, features of tests."""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dealt import dealt

# Folders and beginnings of file names that are never targets; folders of tests.
EXCLUDED = [
    ".git", "docs", "doc", "examples", "example", "benchmarks", "build", "dist", "node_modules", "vendor", "_vendor", "vendored",
    "third_party", "migrations", "__pycache__", ".tox", ".eggs", "site-packages", "logs",
]
EXCLUDED_PREFIXES = ["test_", "conftest", "setup"]
TEST_FOLDERS = ["tests", "test", "testing"]
#: Files that one task parses.
FILES_A_TASK = 10_000
LEAST_LINES, MOST_LINES = 8, 250
METRICS = ["body_lines", "branches", "loops", "while_loops", "max_loop_nesting", "excepts", "raises", "finallys", "calls", "num_local_calls", "assigns",
           "augassigns", "returns", "boolops", "comprehensions", "with_blocks", "breaks_continues"]
FUNCTIONS = "path string, qualname string, lineno int, end_lineno int, n_params int, " + ", ".join(f"{m} int" for m in METRICS) + ", local_calls array<string>"


def is_source(path: Column) -> Column:
    """A Python file outside excluded, hidden and test folders whose name is no test's."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    barred = F.exists(folders, lambda p: p.isin(EXCLUDED + TEST_FOLDERS) | p.endswith("_qa") | (p.startswith(".") & (p != ".")))
    name = F.element_at(F.split(path, "/"), -1)
    return path.endswith(".py") & ~barred & ~name.rlike("^(" + "|".join(EXCLUDED_PREFIXES) + ")")


_LOOPS, _SCOPES = (ast.For, ast.AsyncFor, ast.While), (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)
_COUNTED = {
    "branches": (ast.If,), "loops": _LOOPS, "while_loops": (ast.While,), "raises": (ast.Raise,), "calls": (ast.Call,), "augassigns": (ast.AugAssign,), "returns": (ast.Return,),
    "boolops": (ast.BoolOp,), "comprehensions": (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp), "with_blocks": (ast.With,), "breaks_continues": (ast.Break, ast.Continue),
}


def statements(tree: ast.AST) -> Iterator[ast.AST]:
    """A tree and all statements in it; functions and classes stand nowhere else, so expressions are passed over."""
    todo = [tree]
    while todo:
        node = todo.pop()
        yield node
        for inner in ("body", "orelse", "finalbody", "handlers", "cases"):
            below = getattr(node, inner, None)
            if isinstance(below, list):
                todo += below


def _own_nodes(function: ast.AST) -> list[tuple[ast.AST, int]]:
    """The nodes of a body with the loops around them, without those of inner functions and classes."""
    found, todo = [], [(n, 0) for n in function.body]
    while todo:
        node, depth = todo.pop()
        if not isinstance(node, _SCOPES):
            found.append((node, depth))
            todo += [(child, depth + isinstance(node, _LOOPS)) for child in ast.iter_child_nodes(node)]
    return found


def _metrics(function: ast.AST, module_functions: set[str]) -> dict:
    own = _own_nodes(function)
    kinds = Counter(type(n) for n, _ in own)
    tries = [n for n, _ in own if type(n) is ast.Try]
    called = {getattr(n.func, "id", getattr(n.func, "attr", None)) for n, _ in own if type(n) is ast.Call}
    local = sorted(module_functions & called)
    return {k: sum(map(kinds.__getitem__, of)) for k, of in _COUNTED.items()} | {
        "body_lines": function.end_lineno - function.lineno + 1,
        "max_loop_nesting": max((d + 1 for n, d in own if type(n) in _LOOPS), default=0),
        "excepts": sum(len(t.handlers) for t in tries), "finallys": sum(bool(t.finalbody) for t in tries),
        "assigns": kinds[ast.Assign] + sum(type(n) is ast.AnnAssign and n.value is not None for n, _ in own),
        "num_local_calls": len(local), "local_calls": local,
    }


def _functions(tree: ast.AST, prefix: str = "") -> Iterator[tuple[str, ast.AST]]:
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield prefix + node.name, node
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield from _functions(node, f"{prefix}{node.name}.")


def functions(files: DataFrame, least: int = LEAST_LINES, most: int = MOST_LINES) -> DataFrame:
    """(path, text) -> one row a function of ``least`` to ``most`` lines, without double-underscore names; broken files give none."""
    names = [x.split()[0] for x in FUNCTIONS.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                known = {n.name for n in statements(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
                for name, node in _functions(tree):
                    short = name.rsplit(".", 1)[-1]
                    if least <= node.end_lineno - node.lineno + 1 <= most and not (short.startswith("__") and short.endswith("__")):
                        found = _metrics(node, known)
                        rows.append((path, name, node.lineno, node.end_lineno, len(node.args.args), *(found[m] for m in METRICS), found["local_calls"]))
            yield pd.DataFrame(rows, columns=names)

    return dealt(files.select("path", "text"), each=FILES_A_TASK).mapInPandas(walk, FUNCTIONS)


def structural_score() -> Column:
    """Weight of a function as a target: paths through it, what it does on them, and its size; to two digits."""
    n = F.col
    paths = 1 + n("branches") + n("loops") + n("excepts") + n("boolops")
    richness = n("assigns") + n("augassigns") + 2 * n("max_loop_nesting") + n("raises") + n("breaks_continues") + F.least(n("calls"), F.lit(10))
    return F.round(2 * paths + richness + F.least(n("body_lines"), F.lit(80)) / 10, 2)


def test_features(files: DataFrame) -> DataFrame:
    """(path, text) -> path, source_lines, imports and calls by the syntax tree; broken files have none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"]):
                try:
                    kinds = Counter(map(type, ast.walk(ast.parse(text or ""))))
                    rows.append((path, len((text or "").splitlines()), kinds[ast.Import] + kinds[ast.ImportFrom], kinds[ast.Call]))
                except (SyntaxError, ValueError, RecursionError):
                    rows.append((path, 0, 0, 0))
            yield pd.DataFrame(rows, columns=["path", "source_lines", "imports", "calls"])

    return dealt(files.select("path", "text"), each=FILES_A_TASK).mapInPandas(count, "path string, source_lines int, imports int, calls int")
