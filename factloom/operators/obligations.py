"""What functions must be sure of before they go on: duties on syntax trees, with the guard that meets each, if any."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.operators.rules import dotted

SCHEMA = "file string, function string, line int, kind string, subject string, via string, met boolean, guard string"
Function = ast.FunctionDef | ast.AsyncFunctionDef
_EXITS = (ast.Return, ast.Raise, ast.Continue, ast.Break)
_FULL = {"partition", "rpartition", "split", "splitlines"}
_GRAMMAR = {"targets", "ops", "comparators"}
_JSON = {"JSONDecodeError", "ValueError", "Exception", "BaseException"}


def _mentions(node: ast.AST, subject: str) -> bool:
    return any(isinstance(n, (ast.Name, ast.Attribute)) and dotted(n) == subject for n in ast.walk(node))


def _refutes(test: ast.expr, subject: str) -> bool:
    """Whether the test holds where the subject is missing: not x, x is None, len(x) == 0, len(x) < 1, any of them behind ``or``."""
    if isinstance(test, ast.BoolOp) and isinstance(test.op, ast.Or):
        return any(_refutes(v, subject) for v in test.values)
    if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
        return _asserts(test.operand, subject)
    if isinstance(test, ast.Compare) and len(test.ops) == 1:
        op, right = test.ops[0], test.comparators[0]
        length = isinstance(test.left, ast.Call) and dotted(test.left.func) == "len" and test.left.args and dotted(test.left.args[0]) == subject
        if length and isinstance(right, ast.Constant):
            return (isinstance(op, ast.Eq) and right.value == 0) or (isinstance(op, ast.Lt) and right.value >= 1) or (isinstance(op, ast.LtE) and right.value == 0)
        return dotted(test.left) == subject and isinstance(op, (ast.Is, ast.Eq)) and isinstance(right, ast.Constant) and right.value is None
    return False


def _asserts(test: ast.expr, subject: str) -> bool:
    """Whether the subject is there where the test holds: x, x is not None, len(x) > 0, isinstance(x, ...), any of them within ``and``."""
    if isinstance(test, ast.BoolOp) and isinstance(test.op, ast.And):
        return any(_asserts(v, subject) for v in test.values)
    if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
        return _refutes(test.operand, subject)
    if isinstance(test, ast.Call) and dotted(test.func) in ("isinstance", "len", "bool") and test.args:
        return dotted(test.args[0]) == subject
    if isinstance(test, ast.Compare) and len(test.ops) == 1:
        op, right = test.ops[0], test.comparators[0]
        if isinstance(test.left, ast.Call) and dotted(test.left.func) == "len" and test.left.args and dotted(test.left.args[0]) == subject and isinstance(right, ast.Constant):
            return isinstance(op, (ast.Gt, ast.GtE, ast.Eq)) and isinstance(right.value, int) and right.value >= isinstance(op, (ast.GtE, ast.Eq))
        return dotted(test.left) == subject and isinstance(op, (ast.IsNot, ast.NotEq)) and isinstance(right, ast.Constant) and right.value is None
    return bool(subject) and dotted(test) == subject


def _guard(access: ast.AST, subject: str, f: Function, up: dict[ast.AST, ast.AST]) -> str | None:
    """The test that the access stands behind."""
    child, p = access, up.get(access)
    while p is not None and child is not f:
        if isinstance(p, (ast.If, ast.While, ast.IfExp)):
            inside = child in p.body if isinstance(p.body, list) else child is p.body
            other = child in p.orelse if isinstance(p.orelse, list) else child is p.orelse
            if (inside and _asserts(p.test, subject)) or (other and _refutes(p.test, subject)):
                return ast.unparse(p.test)
        if isinstance(p, ast.BoolOp) and child in p.values:
            before = p.values[: p.values.index(child)]
            if any((_asserts if isinstance(p.op, ast.And) else _refutes)(v, subject) for v in before):
                return ast.unparse(p)
        for block in (getattr(p, k, None) for k in ("body", "orelse", "finalbody")):
            if isinstance(block, list) and child in block:
                for s in block[: block.index(child)]:
                    if isinstance(s, ast.If) and isinstance(s.body[-1], _EXITS) and _refutes(s.test, subject):
                        return ast.unparse(s.test)
                    if isinstance(s, ast.Assert) and _asserts(s.test, subject):
                        return ast.unparse(s.test)
                    if isinstance(s, ast.Assign) and any(dotted(t) == subject for t in s.targets) and isinstance(s.value, (ast.List, ast.Tuple, ast.Set)) and s.value.elts:
                        return ast.unparse(s)
        child, p = p, up.get(p)
    return None


def _in_try(node: ast.AST, up: dict[ast.AST, ast.AST]) -> str | None:
    child, p = node, up.get(node)
    while p is not None:
        if isinstance(p, ast.Try) and child in p.body:
            for h in p.handlers:
                names = [dotted(x).rpartition(".")[2] for x in (h.type.elts if isinstance(h.type, ast.Tuple) else [h.type])] if h.type else [""]
                if h.type is None or set(names) & _JSON:
                    return f"except {', '.join(names)}"
        child, p = p, up.get(p)
    return None


def _own(f: Function) -> Iterator[tuple[ast.AST, str, str, str | None]]:
    """(node, kind, subject, guard) of a function's duties, those of functions inside of it too."""
    up = {c: p for p in ast.walk(f) for c in ast.iter_child_nodes(p)}
    optional = {a.arg for a in f.args.posonlyargs + f.args.args + f.args.kwonlyargs if a.annotation is not None and ("Optional" in (s := ast.unparse(a.annotation)) or "None" in s)}
    optional |= {a.arg for a, d in zip((f.args.posonlyargs + f.args.args)[::-1], f.args.defaults[::-1]) if isinstance(d, ast.Constant) and d.value is None}
    looked = {dotted(n.value) for n in ast.walk(f) if isinstance(n, ast.Attribute) and n.attr in ("returncode", "check_returncode")}
    for n in ast.walk(f):
        if isinstance(n, ast.Call) and dotted(n.func) == "json.loads":
            yield n, "json", ast.unparse(n.args[0]) if n.args else "?", _in_try(n, up)
        elif isinstance(n, ast.Call) and dotted(n.func) in ("subprocess.run", "subprocess.call", "subprocess.popen"):
            check = next((k.value for k in n.keywords if k.arg == "check"), None)
            held = dotted(up[n].targets[0]) if isinstance(up.get(n), ast.Assign) else None
            yield n, "exit code", "...", f"check={ast.unparse(check)}" if isinstance(check, ast.Constant) else f"{held}.returncode" if held in looked else None
        elif isinstance(n, ast.Subscript) and isinstance(n.ctx, ast.Load):
            i = n.slice.operand if isinstance(n.slice, ast.UnaryOp) and isinstance(n.slice.op, ast.USub) else n.slice
            v = n.value
            sure = isinstance(v, (ast.Constant, ast.Dict, ast.Set)) or (isinstance(v, ast.Call) and isinstance(v.func, ast.Attribute) and v.func.attr in _FULL) or (isinstance(v, ast.Attribute) and v.attr in _GRAMMAR)
            if isinstance(i, ast.Constant) and i.value in (0, 1) and type(i.value) is int and (i.value == 0) == (i is n.slice) and not sure:
                yield n, "first or last", ast.unparse(v), _guard(n, dotted(v), f, up)
        elif isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Load) and isinstance(n.value, ast.Name) and n.value.id in optional:
            yield n, "not None", n.value.id, _guard(n, n.value.id, f, up)


def duties_of(text: str | None) -> list[tuple]:
    """(function, line, kind, subject, via, met, guard), each (function, line, kind, subject) once, in order.

    A function has its own duties and, named by ``via``, those of the functions of the file that it calls by name, one
    call away. Files that don't parse, or nest too deep to walk, have none.
    """
    try:
        tree = ast.parse(text or "")
        named: list[tuple[str, Function]] = []
        todo: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())]
        while todo:
            node, path = todo.pop()
            for c in ast.iter_child_nodes(node):
                if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    named.append((".".join((*path, c.name)), c))
                elif isinstance(c, ast.ClassDef):
                    todo.append((c, (*path, c.name)))
                elif isinstance(c, (ast.If, ast.Try, ast.With)):
                    todo.append((c, path))
        own = {name: [(n.lineno, kind, subject, g) for n, kind, subject, g in _own(f)] for name, f in named}
        out: dict[tuple, tuple] = {}
        for name, f in named:
            calls = dict.fromkeys(n.func.id for n in ast.walk(f) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name))
            for via in ("", *(c for c in calls if c in own and c != name)):
                for line, kind, subject, g in own[via or name]:
                    out.setdefault((name, line, kind, subject), (via, g is not None, g))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return [(*k, *v) for k, v in sorted(out.items())]


def duties(files: DataFrame) -> DataFrame:
    """files(file, text): rows of SCHEMA."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, *r) for f, t in zip(b["file"], b["text"]) for r in duties_of(t)], columns=columns)

    return files.select("file", "text").mapInPandas(run, SCHEMA)


def structural_risk(edges: DataFrame, files: DataFrame, *, top: int | None = None) -> DataFrame:
    """(node, betweenness, risk) of cut vertices of edges(src, dst) between functions, by the duties of files(file, text) that they don't meet."""
    open_ = duties(files).where("not met").groupBy(F.col("function").alias("node")).agg(F.count("*").alias("duties"))
    return graph.structural_risk(edges, open_, top=top)
