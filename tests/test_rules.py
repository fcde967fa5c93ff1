"""Rules on small sources, written for these tests: what they flag and what they leave alone."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from factloom.operators import checking, obligations, rules, script_rules
from factloom.sources import python_facts, readers

CASES = [
    ("optional_dereference", "def f(q):\n    x = q.objects.first()\n    return x.name\n", [3]),
    ("optional_dereference", "def f(q):\n    x = q.objects.first()\n    if x:\n        return x.name\n", []),
    ("optional_dereference", "def f(q):\n    x = q.objects.first()\n    x = 1\n    return x.real\n", []),
    ("optional_dereference", "def f(t, k):\n    x = t.get(k)\n    return x.name\n", [3]),
    ("optional_dereference", "def f(t, k):\n    x = t.get(k, 0)\n    return x.name\n", []),
    *[("optional_dereference", f"def f(self, t, k, url):\n    x = {call}\n    return x.name\n", []) for call in ("df.groupby(k).first()", "M.objects.get(1)", "q.filter(k).get(1)", "t.get()", "t.get(pk=1)", "t.get(k, default=0)", "t.get(k, timeout=3)", "t.get(url)", "t.get('/a')", "t.get(f'/a/{k}')", "t.get('/a' + k)", "t.get(k + '/a')", "session.get(k)", "self.client.get(k)", "client.app.get(k)", "self.get(k)", "Registry.get(k)", "t.get(3)", "t.get(idx)")],
    *[("optional_dereference", f"def f(self, t, k, q):\n    x = {call}\n    return x.name\n", [3]) for call in ("M.objects.filter(k).last()", "t.get(k, None)", "TABLE.get(k)", "self.held.get(k)", "t.get('a')")],
    ("optional_dereference", "def f(t, k):\n    if k in t:\n        x = t.get(k)\n        return x.name\n", []),
    ("bare_except", "try:\n    a()\nexcept:\n    b()\n", [3]),
    ("bare_except", "try:\n    a()\nexcept:\n    raise\n", []),
    ("bare_except", "try:\n    a()\nexcept:  # noqa\n    b()\n", []),
    ("mutable_default_arg", "def f(a=[]):\n    a.append(1)\n", [1]),
    ("mutable_default_arg", "def f(a=[]):\n    return len(a)\n", []),
    ("mutable_default_arg", "def f(*, a={}):\n    a['k'] = 1\n", [1]),
    ("missing_await", "async def g():\n    pass\nasync def f():\n    g()\n", [4]),
    ("missing_await", "async def g():\n    pass\nasync def f():\n    await g()\n    t = g()\n    await asyncio.gather(g(), *[g() for _ in x])\n", []),
    ("missing_await", "async def g():\n    pass\ndef f():\n    return g()\n", [4]),
    ("format_arg_mismatch", "'{} {}'.format(1)\n'{{}} {}'.format(1)\n'{a}'.format(a=1)\n'{b}'.format(a=1)\n", [1, 4]),
    ("llm_response_unguarded", "def f(c):\n    r = c.create()\n    return r.choices[0]\n", [3]),
    ("llm_response_unguarded", "def f(c):\n    r = c.create()\n    if not r.choices:\n        return None\n    return r.choices[0]\n", []),
    ("llm_response_unguarded", "def f(c):\n    r = c.create()\n    if not r.choices:\n        return None\n    return r.choices[0].message\n", [5]),
    ("llm_response_unguarded", "def f(c):\n    r = c.create()\n    if r.choices and r.choices[0].message:\n        return r.choices[0].message\n", []),
    ("llm_response_unguarded", "def f(c):\n    r = c.create()\n    if r:\n        e = r.choices[0]\n        return e.delta\n", [5]),
    ("llm_response_unguarded", "def need(x):\n    if not x:\n        raise ValueError\ndef f(c):\n    r = c.create()\n    need(r)\n    return r.choices[0]\n", []),
    ("unvalidated_lookup_chain", "def f(a, b):\n    k = a.get('x')\n    return b[k]\n", [3]),
    ("unvalidated_lookup_chain", "def f(a, b):\n    k = a.get('x')\n    if k in b:\n        return b[k]\n", []),
    ("prompt_injection_risk", "c.create(messages=[{'role': 'user', 'content': f'say {user_text}'}])\n", [1]),
    ("prompt_injection_risk", "c.create(messages=[{'role': 'user', 'content': f'say {count}'}])\n", []),
    ("asyncio_run_in_async", "async def f():\n    asyncio.run(g())\ndef h():\n    asyncio.run(g())\n", [2]),
    ("falsy_or_zero_elision", "x = rate or 0\ny = name or 0\n", [1]),
    ("subprocess_exit_code_unchecked", "subprocess.run(['a'])\nsubprocess.run(['a'], check=True)\n", [1]),
    ("subprocess_exit_code_unchecked", "def f():\n    p = subprocess.run(['a'])\n    return p.returncode\n", []),
    ("json_loads_unguarded", "json.loads(x)\ntry:\n    json.loads(x)\nexcept ValueError:\n    json.loads(x)\n", [1, 5]),
    ("timeout_not_set", "requests.get(u)\nrequests.get(u, timeout=3)\nhttpx.post(u)\n", [1, 3]),
    ("eager_any_guard", "any([a, b[0]])\nany([a, b])\nall([a[0]])\n", [1]),
    ("save_without_update_fields", "import django\ndef f(u):\n    u.save()\n    u.save(update_fields=['a'])\n    v = User()\n    v.save()\n", [3]),
]


@pytest.mark.parametrize("mode, text, lines", CASES)
def test_rule(mode, text, lines):
    assert [r[0] for r in rules.check_text(text) if r[1] == mode] == lines


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(max_size=80))
def test_any_text(text):
    rules.check_text(text)
    python_facts.facts_of(text)


def test_check_and_facts(spark, tmp_path):
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv/x.py").write_text("json.loads(a)\n")
    (tmp_path / "m.py").write_text("import os\nclass A(ABC):\n    f = CharField(null=True)\n    g = CharField()\n    def h(self, a, b=1, *, k):\n        return os.path.join(a, b, sep=k)\ndef test_it_works():\n    assert A\njson.loads(a)\n")
    (tmp_path / "bad.py").write_text("def (")
    files = readers.source_files(spark, str(tmp_path))
    assert files.count() == 2
    assert [(r.line, r.mode) for r in rules.check(files).collect()] == [(9, "json_loads_unguarded")]
    got = {(r.kind, r.name, r.detail, r.n) for r in python_facts.facts(files).collect()}
    assert {("function", "A.h", "plain", 1), ("field", "f", "optional", 0), ("field", "g", "required", 0), ("class", "A", "abstract", 3), ("test", "it works", "A", 1), ("import", "os", None, 0), ("call", "os.path.join", None, 2)} <= got
    assert [r.pkg for r in readers.imports_by_line(files).collect()] == ["os"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"repo": "x", "n": 1}\nnot json\n{"repo": "y", "n": 2}\n')
    assert sorted(r.repo for r in readers.json_lines(spark, f"{tmp_path}/a.jsonl", "repo string, n long").collect()) == ["x", "y"]
    (tmp_path / "g.json").write_text('{"nodes": [{"id": 1}], "links": [{"source": 1, "target": 2, "context": "call"}, {"source": 2, "target": 3, "context": "import"}]}')
    assert [tuple(r) for r in readers.graph_json(spark, f"{tmp_path}/g.json")[1].collect()] == [(1, 2)]
    log = spark.createDataFrame([("s1\x1fann\x1f2024-01-02\x1ffix it\x1fa.py\x1fb.py",), ("junk",)], "value string")
    assert [(r.sha, r.files) for r in readers.commit_log(log).collect()] == [("s1", ["a.py", "b.py"])]
    v = spark.createDataFrame([("f", 1)], "file string, line int")
    readers.write_violations(v, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1
    d = spark.createDataFrame([("f", "a\nfix b\nstem\n")], "file string, text string")
    assert [r.text for r in readers.changelog_lines(d, "stem").collect()] == ["fix b", "stem"]


def test_stream_of_changes(spark, tmp_path):
    from factloom.streaming import incremental

    files = spark.createDataFrame([("a.py", "json.loads(x)\n"), ("b.py", "json.loads(y)\n"), ("c.py", "json.loads(z)\n")], "file string, text string")
    functions = spark.createDataFrame([("a.py", "f"), ("b.py", "g")], "file string, name string")
    calls = spark.createDataFrame([("b.py", "f"), ("b.py", "h")], "file string, callee string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"file": "a.py"}\n')
    q = incremental.watch(spark.readStream.schema("file string").json(f"{tmp_path}/in"), lambda: (files, functions, calls), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert sorted(r.file for r in spark.read.json(f"{tmp_path}/out").collect()) == ["a.py", "b.py"]


SCRIPTS = [
    ("a.ts", "async function load() {\n  fetch('/x');\n  const r = await fetch('/y');\n  return axios.get('z');\n}\nasync function g() { load(); client.save(1) }\nfunction h() { fetch('/q') }\n", [(2, "missing_await"), (6, "missing_await"), (6, "missing_await")]),
    ("a.ts", "const f = async () => { save_all(); await fetch(u) };\nconst g = async (x) => fetch(x);\nclass A { async run() { this.run() } }\n", [(2, "missing_await"), (3, "missing_await")]),
    ("a.ts", "const x = arr.find(a => a.id === 1);\nx.name;\nx?.name;\nconst n = list.length;\nn.foo;\n", [(2, "optional_dereference")]),
    ("a.js", "try { a() } catch (e) { }\ntry { a() } catch (e) { // nothing\n }\ntry { a() } catch { log() }\n", [(1, "bare_except"), (2, "bare_except")]),
    ("a.tsx", "const v = m.get(k).name;\nm.get(k)?.name;\nm.get(k);\nr.choices[0].message;\nr.choices?.[0];\nr.choices[1];\n'x.choices[0]'\n", [(1, "unvalidated_lookup_chain"), (4, "llm_response_unguarded")]),
    ("a.go", 'func f() {\n x, _ := os.Open("a")\n y, _ := foo.Bar()\n z, _ := a.B().ParseErr(1)\n', []),
    ("a.go", 'func f() {\n x, _ := os.Open("a")\n y, _ := foo.Bar()\n z, _ := a.B().ParseErr(1)\n}\n', [(2, "go_ignored_error"), (4, "go_ignored_error")]),
    ("a.go", "func f() {\n defer func() { recover() }()\n defer func() { if r := recover(); r != nil { log(r) } }()\n}\n", [(2, "go_bare_recover")]),
    ("a.go", "func f() {\n v := x.(int)\n w, ok := x.(int)\n switch z := x.(type) { }\n}\n", [(2, "go_unchecked_assertion")]),
    ("a.go", "func f() {\n go func() { work(1) }()\n go func() { defer wg.Done() }()\n}\n", [(2, "go_goroutine_no_sync")]),
    ("a_test.go", 'func f() {\n x, _ := os.Open("a")\n}\n', []),
]


@pytest.mark.parametrize("file, text, want", SCRIPTS)
def test_script_rule(file, text, want):
    assert [(r[0], r[1]) for r in script_rules.check_text(file, text)] == want


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="ab.(){}[]=>;:,_ \n'\"`/*go func async await const catch get find", max_size=60))
def test_any_script(text):
    script_rules.check_text("a.ts", text)
    script_rules.check_text("a.go", text)


def test_rules_of_tests(spark):
    text = "def f(q):\n    x = q.objects.first()\n    return x.name\n"
    files = spark.createDataFrame([(f, text) for f in ("a.py", "test_a.py", "x/tests/a.py", "conftest.py", "a_test.py")], "file string, text string")
    assert [r.file for r in rules.check(files).collect()] == ["a.py"]


def test_deep_trees():
    """Trees deeper than Python's stack give facts, or nothing, but never an error."""
    for text in (" + ".join(f"n{i}" for i in range(1500)) + "\nf(1)\n", "x" + ".a()" * 600 + "\njson.loads(y)\n", "(" * 150 + ")" * 150):
        rules.check_text(text)
        python_facts.facts_of(text)
    assert ("f", 1) in {(r[2], r[5]) for r in python_facts.facts_of(" + ".join(f"n{i}" for i in range(900)) + "\nf(1)\n") if r[0] == "call"}


FACTS = """
import click
class M(Base):
    a = models.CharField(max_length=5, choices=[("x", "X"), ("y", "Y")])
    b = models.PositiveSmallIntegerField()
    c = models.IntegerField(null=True)
    d = models.ManyToManyField(M)
    e = models.CharField()
    def save(self):
        if not self.e:
            self.e = 1
def need(a, b, *, k):
    pass
class C:
    def meth(self, x, y=1):
        pass
@pytest.fixture
def fix(a):
    pass
@click.command()
def main(a):
    pass
@intrinsic
def jit(typingctx, v):
    pass
def dup(a): pass
def dup(a): pass
def use(o):
    need(1)
    need(1, 2, k=3)
    need(*a)
    need(1, **kw)
    fix()
    main()
    jit(3)
    dup()
    o.need(1, k=2)
    local = 3
    need = lambda: 0
    need()
    M.objects.create(a="toolong", b=-1)
    M.objects.create(a="x", b=7, c=2**40)
    "".join(q)
if __name__ == "__main__":
    need()
else:
    need()
"""


def test_required_arguments_and_fields(spark):
    """The rules over facts, and what they leave alone."""
    files = spark.createDataFrame([("m.py", FACTS), ("bad.py", "def ("), ("a.ts", "try { a() } catch (e) { }\n"), (None, None)], "file string, text string")
    got = {(r.line, r.mode, r.message) for r in checking.check(files).collect() if r.mode in ("required_arg_missing", "model_constraint")}
    first = FACTS.split("\n").index("    need(1)") + 1
    create = FACTS.split("\n").index('    M.objects.create(a="toolong", b=-1)') + 1
    last = FACTS.rstrip("\n").count("\n") + 1
    assert got == {(first, "required_arg_missing", "left out: b, k"), (create, "model_constraint", "a: no choice, a: too long, b: too small"), (last, "required_arg_missing", "left out: a, b, k")}


def test_check_is_one_ordered_union(spark):
    files = spark.createDataFrame([("m.py", "import json\njson.loads(x)\n"), ("a.ts", "try { a() } catch (e) { }\n"), ("n.py", "json.loads(y)\n")], "file string, text string")
    capture = spark.createDataFrame([("m.py", 9, "json_loads_unguarded", "json.loads", "again"), ("m.py", 3, "timeout_not_set", "x", "new"), ("m.py", 3, "timeout_not_set", "x", "new")], "file string, line int, mode string, call string, message string")
    rows = {(r.file, r.line, r.mode, r.source) for r in checking.check(files, captures=(capture,)).collect()}
    assert rows == {("m.py", 2, "json_loads_unguarded", 0), ("n.py", 1, "json_loads_unguarded", 0), ("a.ts", 1, "bare_except", 2), ("m.py", 3, "timeout_not_set", 3)}
    changed = spark.createDataFrame([("n.py",)], "file string")
    assert [r.file for r in checking.check(files, changed=changed).collect()] == ["n.py"]


def test_own_rule(spark):
    """A rule of one's own has the signature of the others."""

    def no_print(tree, text):
        for n in rules.ast.walk(tree):
            if isinstance(n, rules.ast.Call) and rules.dotted(n.func) == "print":
                yield n.lineno, "print", "prints"

    files = spark.createDataFrame([("m.py", "print(1)\njson.loads(x)\n")], "file string, text string")
    assert [(r.line, r.mode) for r in rules.check(files, {"no_print": no_print}).collect()] == [(1, "no_print")]


def test_source_files(spark, tmp_path):
    """Which folders and backups are left out."""
    for f in ("build/x.py", "env/y.py", "vendor/v.py", ".github/w.py", "a.backup.py", "b_backup.py", "c.py", "d.txt", "src/e.ts", "dist/f.ts", "g_test.go", "h.go", "testdata/i.go", ".hid/j.go"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("x\n")
    name = lambda df: sorted(r.file.rpartition("/")[2] for r in df.collect())
    assert name(readers.source_files(spark, str(tmp_path))) == ["c.py", "x.py", "y.py"]
    assert name(readers.script_files(spark, str(tmp_path))) == ["e.ts"]
    assert name(readers.go_files(spark, str(tmp_path))) == ["h.go"]


def test_captures(spark, tmp_path):
    files = spark.createDataFrame([("m.py", "a\nx.first().name  # noqa\ny.first().name\ntry:\n    a()\nexcept:\n    raise\n")], "file string, text string")
    place = lambda line, a, end=None, b=20: {"start": {"line": line, "col": a}, "end": {"line": end or line, "col": b}}
    found = [{"check_id": f"r.{rule}", "path": "m.py", **where, "extra": {"message": "m"}} for rule, where in (("queryset-first-none-dereference", place(2, 1)), ("queryset-first-none-dereference", place(3, 1, b=15)), ("bare-except", place(4, 1, 7)), ("unknown", place(1, 1)))]
    (tmp_path / "s.json").write_text(json.dumps({"results": found}))
    assert [tuple(r) for r in readers.semgrep(spark, f"{tmp_path}/s.json", files).collect()] == [("m.py", 3, "optional_dereference", "y.first().name", "m")]
    lines = [{"file": "m.py", "line": 3, "severity": "error", "code": "union-attr", "message": "Item None"}, {"file": "m.py", "line": 2, "severity": "error", "code": "union-attr", "message": "x"}, {"file": "vendor/m.py", "line": 3, "severity": "error", "code": "union-attr", "message": "x"}, {"file": "m.py", "line": 3, "severity": "note", "code": "union-attr", "message": "x"}, {"file": "m.py", "line": 1, "severity": "error", "code": "attr-defined", "message": '"None" has no attribute "a"'}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    assert {(r.line, r.message) for r in readers.mypy(spark, f"{tmp_path}/p.jsonl", files).collect()} == {(3, "mypy [union-attr]: Item None"), (1, 'mypy [attr-defined]: "None" has no attribute "a"')}
    (tmp_path / "i.json").write_text(json.dumps([{"number": 1, "title": "t", "state": "OPEN", "labels": [{"name": "bug"}], "author": {"login": "ann"}, "createdAt": "2024-01-02T03:04:05Z"}]))
    assert [(r.number, r.state, r.labels, r.author, str(r.created)) for r in readers.issues(spark, f"{tmp_path}/i.json").collect()] == [(1, "open", ["bug"], "ann", "2024-01-02")]
    (tmp_path / "log.txt").write_text("\0s1\x1fann\x1f2024-01-02 10:00\x1ffix\n\na.py\nb.py\n\0s2\x1fbob\x1f2024-01-03\x1fadd\n")
    assert [(r.sha, r.files) for r in readers.git_log(spark, f"{tmp_path}/log.txt").collect()] == [("s1", ["a.py", "b.py"]), ("s2", [])]
    (tmp_path / "c.jsonl").write_text(json.dumps({"sha": "s", "author": "a", "date": "2024-01-02", "files": [{"path": "a.py", "complexity": 3}, {"path": "b.md"}]}) + "\n")
    assert [(r.path, r.complexity) for r in readers.mined_commits(spark, f"{tmp_path}/c.jsonl").collect()] == [("a.py", 3.0)]
    (tmp_path / "tree/docs").mkdir(parents=True)
    (tmp_path / "tree/docs/z.md").write_text("z" * 9000)
    (tmp_path / "tree/README.md").write_text("hello")
    (tmp_path / "tree/other.md").write_text("no")
    assert [(r.rank, len(r.text)) for r in readers.docs_scan(spark, f"{tmp_path}/tree").collect()] == [(0, 5), (1, 8000)]


def test_written_reports(spark, tmp_path):
    v = spark.createDataFrame([("b.py", 2, "m", "c"), ("a.py", 1, "m", "c")], "file string, line int, mode string, call string")
    readers.write_violations(v, f"{tmp_path}/arr", array=True)
    text = "".join(p.read_text() for p in (tmp_path / "arr").glob("part-*"))
    assert [x["file"] for x in json.loads(text)] == ["a.py", "b.py"]
    readers.write_violations(v, f"{tmp_path}/lines")
    readers.write_violations(v, f"{tmp_path}/lines", mode="append")
    assert spark.read.json(f"{tmp_path}/lines").count() == 4
    assert readers.comment(v).first().text.split("\n")[0] == "### 2 findings" and "`a.py:1`" in readers.comment(v, most=1).first().text


DUTIES = '''
def first(x):
    return x[0]
def safe(x):
    if not x:
        return None
    return x[0]
def inside(x):
    if len(x) > 0:
        return x[-1]
    return x[-1]
def short(x):
    return x and x[0]
def late(x):
    y = x[0]
    assert x
    return y, "a b".split()[0], x[1]
def load(t, o: Optional[int] = None):
    try:
        json.loads(t)
    except ValueError:
        pass
    subprocess.run(["a"], check=True)
    r = subprocess.run(["b"])
    subprocess.run(["c"])
    return o.real, r.returncode, json.loads(t)
def via(t):
    return first(t) if t is not None else load(t)
class C:
    def m(self, a=None):
        if a is None:
            raise ValueError
        return a.x
'''


def test_duties():
    got = {(r[0], r[1], r[2]): r[5] for r in obligations.duties_of(DUTIES) if not r[4]}
    assert got == {("first", 3, "first or last"): False, ("safe", 7, "first or last"): True, ("inside", 10, "first or last"): True, ("inside", 11, "first or last"): False, ("short", 13, "first or last"): True, ("late", 15, "first or last"): False,
                   ("load", 20, "json"): True, ("load", 23, "exit code"): True, ("load", 24, "exit code"): True, ("load", 25, "exit code"): False, ("load", 26, "not None"): False, ("load", 26, "json"): False, ("C.m", 33, "not None"): True}
    assert {(r[1], r[4]) for r in obligations.duties_of(DUTIES) if r[0] == "via"} == {(3, "first"), (20, "load"), (23, "load"), (24, "load"), (25, "load"), (26, "load")}
    assert obligations.duties_of("def (") == [] and obligations.duties_of(None) == [] and obligations.duties_of("x[0]\n") == []


def test_risk_of_derived_duties(spark):
    files = spark.createDataFrame([("m.py", "def a(x):\n    return b(x)[0]\ndef b(x):\n    return x[0], x[-1]\ndef c(x):\n    return b(x)\n")], "file string, text string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = {r.node: (round(r.betweenness, 6), round(r.risk, 6)) for r in obligations.structural_risk(edges, files).collect()}
    assert got == {"b": (0.666667, 1.333333), "c": (0.666667, 1.333333)}


def test_cache(spark, tmp_path):
    from factloom.streaming import incremental

    path = f"{tmp_path}/cache"
    frame = lambda rows: spark.createDataFrame(rows, "file string, text string")
    one = incremental.check_cached(frame([("a.py", "json.loads(x)\n"), ("b.py", "x = 1\n")]), path)
    assert [(r.file, r.line) for r in one.collect()] == [("a.py", 1)] and spark.read.parquet(path).count() == 2
    two = incremental.check_cached(frame([("a.py", "json.loads(x)\n"), ("b.py", "\njson.loads(x)\n")]), path)
    assert sorted((r.file, r.line) for r in two.collect()) == [("a.py", 1), ("b.py", 2)] and spark.read.parquet(path).count() == 3


def test_command_line(spark, tmp_path, capsys):
    from factloom.__main__ import main

    (tmp_path / "src").mkdir()
    (tmp_path / "src/m.py").write_text("json.loads(x)\n")
    (tmp_path / "src/a.go").write_text("package a\nfunc f() {\n x, _ := os.Open(1)\n}\n")
    assert main(["check", f"{tmp_path}/src", "--out", f"{tmp_path}/out", "--array"]) == 0
    rows = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    assert [r["mode"] for r in rows] == ["go_ignored_error", "json_loads_unguarded"]
    assert main(["check", f"{tmp_path}/src"]) == 0 and "### 2 findings" in capsys.readouterr().out
