"""Facts of Python files: functions, calls, model fields, imports, classes and tests, in one parse of each file.

Rows of SCHEMA are general; ``tables`` binds them to the relations that ``operators.constraints`` joins.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.rules import dotted

SCHEMA = "file string, kind string, line int, name string, owner string, detail string, n int, fields array<string>, flags array<string>, values map<string,string>"
INJECTORS = {"db_session", "transaction", "use_session", "with_session", "session_scope", "transactional", "in_transaction", "inject_session"}
#: Least and greatest value that a column type holds.
BOUNDS = {
    "SmallIntegerField": (-(2**15), 2**15 - 1), "IntegerField": (-(2**31), 2**31 - 1), "BigIntegerField": (-(2**63), 2**63 - 1),
    "PositiveSmallIntegerField": (0, 2**15 - 1), "PositiveIntegerField": (0, 2**31 - 1), "PositiveBigIntegerField": (0, 2**63 - 1),
}


def _keyword(call: ast.Call, name: str) -> ast.expr | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def _literal(node: ast.expr | None) -> object:
    """The str, int or bool that a node writes out; None for anything else."""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and type(node.operand.value) is int:
        return -node.operand.value
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, (str, int, bool)) else None


def _choices(node: ast.expr | None) -> list:
    values = [_literal(e.elts[0] if isinstance(e, (ast.Tuple, ast.List)) and e.elts else e) for e in node.elts] if isinstance(node, (ast.List, ast.Tuple)) else []
    return [v for v in values if v is not None]


def _set_in_save(cls: ast.ClassDef) -> set[str]:
    """Fields that ``save`` fills where they are empty: if not self.f: self.f = ..."""
    out = set()
    for f in ast.walk(cls):
        if not (isinstance(f, ast.FunctionDef) and f.name == "save"):
            continue
        for s in ast.walk(f):
            if isinstance(s, ast.If) and isinstance(s.test, ast.UnaryOp) and isinstance(s.test.op, ast.Not) and dotted(s.test.operand).startswith("self."):
                held = dotted(s.test.operand)
                for x in s.body:
                    if held in [dotted(t) for t in (x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, (ast.AnnAssign, ast.AugAssign)) else [])]:
                        out.add(held[5:])
    return out


def _field(name: str, call: ast.Call, model: str, saved: set[str]) -> tuple:
    kind = dotted(call.func).rpartition(".")[2]
    on = {k for k in ("null", "blank", "unique", "auto_now", "auto_now_add") if _literal(_keyword(call, k)) is True}
    relation = kind.startswith("ManyToMany") or kind.endswith("Rel")
    required = not relation and not on & {"null", "blank", "auto_now", "auto_now_add"} and _keyword(call, "default") is None and name not in saved
    low, high = BOUNDS.get(kind, (None, None))
    values = {"type": kind}
    for key, value in (("max_length", _literal(_keyword(call, "max_length"))), ("min_value", _literal(_keyword(call, "min_value"))), ("max_value", _literal(_keyword(call, "max_value")))):
        value = value if type(value) is int else {"min_value": low, "max_value": high}.get(key)
        if value is not None:
            values[key] = str(value)
    choices = _choices(_keyword(call, "choices"))
    if choices:
        values["choices"] = json.dumps(choices)
    return ("field", call.lineno, name, model, "required" if required else "optional", 0, [], sorted(on & {"null", "blank", "unique"}), values)


def _decorators(f: ast.AST) -> set[str]:
    return {dotted(d.func if isinstance(d, ast.Call) else d).rpartition(".")[2] for d in f.decorator_list}


def _function(n: ast.AST, name: str, owner: str | None) -> tuple:
    a, on = n.args, _decorators(n)
    args = [(x.arg, i < len(a.posonlyargs + a.args) - len(a.defaults)) for i, x in enumerate(a.posonlyargs + a.args) if x.arg not in ("self", "cls")]
    if on & {"intrinsic", "type_callable", "overload"}:
        args = [x for x in args if x[0] != "typingctx"]
    fields = [x if need else x + "=" for x, need in args] + ["*" + k.arg + ("" if d is None else "=") for k, d in zip(a.kwonlyargs, a.kw_defaults) if k.arg not in ("self", "cls")]
    flags = [k for k, yes in (("fixture", "fixture" in on), ("command", on & {"command", "group"}), ("injected", on & INJECTORS)) if yes]
    return ("function", n.lineno, name, owner, "async" if isinstance(n, ast.AsyncFunctionDef) else "plain", sum(need for _, need in args), fields, flags, {})


def _call(n: ast.Call, caller: str | None, local: list[set[str]], in_main: bool) -> tuple | None:
    f, names = n.func, dotted(n.func).strip(".")
    create = isinstance(f, ast.Attribute) and f.attr == "create" and isinstance(f.value, ast.Attribute) and f.value.attr == "objects"
    if create:
        names = (f.value.value.id if isinstance(f.value.value, ast.Name) else "?") + ".objects.create"
    elif not names or (isinstance(f, ast.Attribute) and isinstance(f.value, (ast.Constant, ast.JoinedStr))):
        return None
    keywords = sorted(k.arg for k in n.keywords if k.arg)
    flags = [
        k for k, yes in (("var_args", any(isinstance(x, ast.Starred) for x in n.args)), ("var_kwargs", any(k.arg is None for k in n.keywords)), ("create", create), ("method", isinstance(f, ast.Attribute)), ("main", in_main), ("local", isinstance(f, ast.Name) and any(f.id in x for x in local)))
        if yes
    ]
    values = {k.arg: json.dumps(v) for k in n.keywords if k.arg and (v := _literal(k.value)) is not None}
    return ("call", n.lineno, names, caller, None, sum(not isinstance(x, ast.Starred) for x in n.args), keywords, flags, values)


def _is_main(test: ast.expr) -> bool:
    if not (isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], ast.Eq)):
        return False
    both = [test.left, test.comparators[0]]
    return any(isinstance(x, ast.Name) and x.id == "__name__" for x in both) and any(isinstance(x, ast.Constant) and x.value == "__main__" for x in both)


def facts_of(text: str | None) -> list[tuple]:
    """(kind, line, name, owner, detail, n, fields, flags, values) rows; none if the text does not parse. Nests of any depth are walked.

    function: qualified name, required positional arguments, all arguments but self and cls ("a" required, "a=" not,
    "*a" by keyword only), flags fixture, command, injected; call: callee, caller, positional arguments, keywords, flags
    var_args, var_kwargs, create, method, main, local, and the keywords' literals as JSON; field: model, whether required,
    type and bounds; import: target; class: whether abstract, bases; test: what it is called, without its prefix,
    its asserts, and the first of them.
    """
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple] = []
    todo: list[tuple] = [(n, (), None, None, [], False) for n in reversed(tree.body)]
    while todo:
        n, classes, caller, model, local, in_main = todo.pop()
        children = list(ast.iter_child_nodes(n))
        marked: dict[int, bool] = {}
        if isinstance(n, ast.ClassDef):
            bases = {dotted(b).rpartition(".")[2] for b in n.bases}
            abstract = bool(bases & {"ABC", "Protocol"}) or any("abstractmethod" in _decorators(f) for f in n.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)))
            out.append(("class", n.lineno, n.name, ".".join(classes) or None, "abstract" if abstract else "concrete", len(n.body), sorted(bases), [], {}))
            is_model = any(isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.value, ast.Call) and dotted(s.value.func).endswith("Field") for s in n.body)
            model, classes = (n.name, _set_in_save(n)) if is_model else model, (*classes, n.name)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(_function(n, ".".join((*classes, n.name)), ".".join(classes) or None))
            if n.name.startswith("test_"):
                asserts = [x for x in ast.walk(n) if isinstance(x, ast.Assert)]
                first = (ast.get_source_segment(text, asserts[0].test) or "")[:200] if asserts else None
                out.append(("test", n.lineno, n.name[5:].replace("_", " "), ".".join(classes) or None, first, len(asserts), [], [], {}))
            caller, local = ".".join((*classes, n.name)), [*local, set()]
        elif isinstance(n, ast.Assign):
            names = [t.id for t in n.targets if isinstance(t, ast.Name)]
            if local:
                local[-1].update(names)
            if model and len(n.targets) == 1 and names and isinstance(n.value, ast.Call) and dotted(n.value.func).endswith("Field"):
                out.append(_field(names[0], n.value, *model))
        elif isinstance(n, ast.If) and _is_main(n.test):
            marked = {id(s): True for s in n.body}
        elif isinstance(n, ast.Import):
            out.extend(("import", n.lineno, x.name, None, None, 0, [], [], {}) for x in n.names)
        elif isinstance(n, ast.ImportFrom) and n.module:
            out.append(("import", n.lineno, n.module, None, None, n.level, sorted(x.name for x in n.names), [], {}))
        elif isinstance(n, ast.Call) and (row := _call(n, caller, local, in_main)):
            out.append(row)
        todo.extend((c, classes, caller, model, local, marked.get(id(c), in_main)) for c in reversed(children))
    return out


def facts(files: DataFrame) -> DataFrame:
    """files(file, text): rows of SCHEMA."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, *r) for f, t in zip(b["file"], b["text"]) for r in facts_of(t)], columns=columns)

    return files.select("file", "text").mapInPandas(run, SCHEMA)


def tables(held: DataFrame) -> dict[str, DataFrame]:
    """The relations of ``operators.constraints`` from rows of SCHEMA: calls, call_keywords, functions, function_args, fields, choices."""
    flag = lambda x: F.array_contains("flags", x)
    calls = held.where("kind = 'call'").withColumn("seq", F.xxhash64("file", "line", "name", "owner", "n", F.to_json("fields"), F.to_json("flags"), F.to_json(F.array_sort(F.map_entries("values")))))
    functions = held.where("kind = 'function'").withColumn("func_id", F.xxhash64("file", "line", "name"))
    arg = functions.select("func_id", F.posexplode("fields").alias("pos", "a"))
    fields = held.where("kind = 'field'")
    value = lambda k, t: F.element_at("values", k).cast(t).alias(k)
    return {
        "calls": calls.select("seq", "file", "line", F.col("name").alias("callee"), F.col("owner").alias("caller"), F.col("n").alias("n_positional"), (flag("var_args") | flag("var_kwargs")).alias("spread"), flag("create").alias("is_create"), flag("method").alias("is_method"), flag("main").alias("in_main"), flag("local").alias("is_local")),
        "call_keywords": calls.select("seq", F.explode("fields").alias("arg")).join(calls.select("seq", F.explode("values").alias("arg", "value")), ["seq", "arg"], "left"),
        "functions": functions.select("func_id", "name", "file", "line", (F.size("flags") > 0).alias("is_called_otherwise")),
        "function_args": arg.select("func_id", "pos", F.regexp_replace("a", "[*=]", "").alias("arg"), (~F.col("a").endswith("=")).alias("required"), F.col("a").startswith("*").alias("kwonly")),
        "fields": fields.select(F.col("owner").alias("model"), F.col("name").alias("field"), (F.col("detail") == "required").alias("required"), F.element_at("values", "type").alias("field_type"), value("max_length", "long"), value("min_value", "long"), value("max_value", "long")),
        "choices": fields.select(F.col("owner").alias("model"), F.col("name").alias("field"), F.explode(F.from_json(F.element_at("values", "choices"), "array<string>")).alias("choice")),
    }
