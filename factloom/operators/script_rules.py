"""Rule checks on TypeScript, JavaScript and Go source, over tokens instead of a syntax tree.

A text is cut into names, numbers, strings and marks with their lines; comments go. Brackets are matched, which is all
the structure that these rules ask for. Texts whose brackets don't match give nothing. Each rule yields (line, call,
message); ``check`` runs those of a file's suffix in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

Found = Iterator[tuple[int, str, str]]
SCHEMA = "file string, line int, mode string, call string, message string"
SCRIPT, GO = (".cjs", ".js", ".jsx", ".mjs", ".ts", ".tsx"), (".go",)

_TOKEN = re.compile(r"""
 (?P<skip>\s+|//[^\n]*|/\*.*?\*/)
|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)
|(?P<name>[A-Za-z_$][\w$]*)
|(?P<number>\d[\w.]*)
|(?P<mark>\?\.|=>|:=|&&|\|\||\?\?|[=!<>]=+|\.\.\.|.)
""", re.X | re.S)  # fmt: skip


@dataclass
class Tokens:
    text: list[str]
    kind: list[str]
    line: list[int]
    match: dict[int, int]  # of each bracket the other

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def callee(self, i: int) -> tuple[int, str, str]:
        """For the name before a call's bracket: where its chain of names begins, the chain before the name, and the name."""
        k = i
        while self.at(k - 1) in (".", "?.") and k > 1 and (self.kind[k - 2] == "name" or self.text[k - 2] in ")]"):
            k -= 2
            while k in self.match and self.text[k] in ")]":
                k = self.match[k]
                if k and (self.kind[k - 1] == "name" or self.text[k - 1] in ")]"):
                    k -= 1
        return k, "".join(self.text[k : i - 1]) if k < i else "", self.text[i]


def tokens(source: str) -> Tokens | None:
    text, kind, line, match, open_, now = [], [], [], {}, [], 1
    for m in _TOKEN.finditer(source):
        k, s = m.lastgroup, m.group()
        if k != "skip":
            if k == "mark" and s in "([{":
                open_.append(len(text))
            elif k == "mark" and s in ")]}":
                if not open_ or text[open_[-1]] + s not in ("()", "[]", "{}"):
                    return None
                a = open_.pop()
                match[a], match[len(text)] = len(text), a
            text.append(s)
            kind.append(k)
            line.append(now)
        now += s.count("\n")
    return None if open_ else Tokens(text, kind, line, match)


# ---- TypeScript and JavaScript

PROMISING = {"got", "stat", "axios", "fetch", "mkdir", "rename", "unlink", "readdir", "copyFile", "readFile", "writeFile", "superagent"}
PROMISING_METHODS = set("end get put blob emit exec head json load open post read save send sync text close fetch flush patch query write commit delete upload connect publish refresh request download formData rollback subscribe disconnect arrayBuffer".split())
MAYBE = {"at", "pop", "find", "shift"}
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "function", "await", "typeof", "new", "with"}


def _bodies(t: Tokens) -> Iterator[tuple[int, int, str, bool]]:
    """First and last token of each function's body, its name and whether it is async."""
    for i, s in enumerate(t.text):
        if s == "=>":
            k = t.match[i - 1] if t.at(i - 1) == ")" else i - 1
            is_async = t.at(k - 1) == "async"
            k -= is_async
            name = t.at(k - 2) if t.at(k - 1) == "=" else ""
            if t.at(i + 1) == "{":
                yield i + 1, t.match[i + 1], name, is_async
            else:
                end = i + 1
                while end < len(t.text) and t.text[end] not in (";", ",", ")", "]", "}"):
                    end = t.match[end] + 1 if end in t.match else end + 1
                yield i + 1, end - 1, name, is_async
        elif s == "(" and t.kind[i - 1 : i] == ["name"] and t.text[i - 1] not in _CONTROL - {"function"}:
            name, k = t.text[i - 1], i - 1
            if name == "function":
                name = ""
            elif t.at(k - 1) == "function":
                k -= 1
            body = t.match[i] + 1
            if t.at(body) == ":":  # the type of what it returns
                while body < len(t.text) and t.text[body] not in ("{", ";", "=>", ")"):
                    body += 1
            if t.at(body) == "{" and (t.text[k] == "function" or t.at(k - 1) in ("{", "}", ";", "async", "static", "public", "private", "protected", "get", "set", "override")):
                yield body, t.match[body], name, t.at(k - 1) == "async"


def ts_missing_await(t: Tokens) -> Found:
    """Calls of what promises, inside of async functions, that are neither awaited nor returned."""
    bodies = sorted(_bodies(t))
    known = {name for _, _, name, a in bodies if a and name}
    inner: dict[int, tuple[int, int, bool]] = {}
    for lo, hi, _, a in bodies:  # the innermost wins, as it comes last
        for i in range(lo, hi + 1):
            inner[i] = (lo, hi, a)
    for i, s in enumerate(t.text):
        if s != "(" or t.kind[i - 1 : i] != ["name"] or t.text[i - 1] in _CONTROL or not inner.get(i, (0, 0, False))[2]:
            continue
        begin, chain, name = t.callee(i - 1)
        root = re.split(r"\?\.|\.", chain)[0] if chain else name
        if not ((chain or name) in PROMISING or (name in PROMISING_METHODS and chain) or root in known or name in known) or t.at(begin - 1) == "function":
            continue
        lo, safe = inner[i][0], False
        k = begin - 1
        while k > lo and t.text[k] not in (";", "{", "}"):  # back to where its statement begins
            if t.text[k] in ("await", "return"):
                safe = True
                break
            k = t.match[k] - 1 if k in t.match and t.text[k] in ")]" else k - 1
        declared = t.at(t.match[i] + 1) == "{" or (t.at(begin - 1) in ("async", "{", ";", "}") and t.at(t.match[i] + 1) == ":")
        if not safe and not declared:
            yield t.line[begin], "".join(t.text[begin : t.match[i] + 1])[:60], "what it promises is never waited for"


def ts_optional_dereference(t: Tokens) -> Found:
    """Variables that hold what an array may not have, read without ``?.``; a comparison or condition right at the read is a guard."""
    held = set()
    for i, s in enumerate(t.text):
        if s in ("const", "let", "var") and t.kind[i + 1 : i + 2] == ["name"]:
            k = i + 2
            while k < len(t.text) and t.text[k] not in ("=", ";", "(", "{"):
                k += 1
            end, last = k + 1, -1
            while t.at(k) == "=" and end < len(t.text) and t.text[end] not in (";", ",", "}", ")", "]") and t.line[end] - t.line[end - 1] < 2:
                if t.text[end] == "(":
                    last = end
                end = t.match[end] + 1 if end in t.match else end + 1
            if last > 0 and t.at(last - 2) in (".", "?.") and t.text[last - 1] in MAYBE and t.match[last] + 1 >= end - 1:
                held.add(t.text[i + 1])
    binary = {"&&", "||", "??", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "+", "-", "*", "/", "%", "?"}
    for i, s in enumerate(t.text):
        if s in held and t.kind[i] == "name" and t.at(i + 1) == "." and t.kind[i + 2 : i + 3] == ["name"] and t.at(i - 1) not in (".", "?.") and t.at(i + 3) not in binary and t.at(i - 1) not in binary:
            yield t.line[i], f"{s}.{t.text[i + 2]}", f"{s} may be undefined"


def ts_empty_catch(t: Tokens) -> Found:
    for i, s in enumerate(t.text):
        if s == "catch" and t.at(i - 1) == "}":
            k = t.match[i + 1] + 1 if t.at(i + 1) == "(" else i + 1
            if t.at(k) == "{" and t.match[k] == k + 1:
                yield t.line[i], "catch", "exceptions are swallowed"


def ts_unvalidated_lookup_chain(t: Tokens) -> Found:
    for i, s in enumerate(t.text):
        if s == "get" and t.at(i - 1) in (".", "?.") and t.at(i + 1) == "(" and t.at(t.match[i + 1] + 1) in (".", "["):
            begin = t.callee(i)[0]
            yield t.line[begin], "".join(t.text[begin : t.match[i + 1] + 1])[:80], "a missing key gives undefined, which is read"


def ts_llm_response_unguarded(t: Tokens) -> Found:
    for i, s in enumerate(t.text):
        if s == "choices" and t.at(i - 1) in (".", "?.") and t.text[i + 1 : i + 4] == ["[", "0", "]"]:
            begin = t.callee(i)[0]
            yield t.line[begin], "".join(t.text[begin : i + 4])[:120], "the list of choices may be empty"


# ---- Go

FAILING = set("Dial Exec Open Read Recv Scan Send Stat Begin Close Mkdir Parse Query Write Accept Commit Create Decode Encode Listen Remove Rename Connect Marshal Prepare ReadDir MkdirAll ReadFile Rollback Unmarshal WriteFile".split())
SYNC = ("ch", "wg", "Add", "ctx", "Done", "Wait", "done", "errCh", "group", "cancel")


def _chain(t: Tokens, i: int) -> tuple[int, str]:
    """End of a dotted chain of names, calls aside, that begins at i, and its last name."""
    while t.at(i + 1) == "." and t.kind[i + 2 : i + 3] == ["name"]:
        i += 2
    return i, t.at(i)


def go_ignored_error(t: Tokens) -> Found:
    """x, _ := f(): the last value of a call that by its name returns an error is dropped."""
    for i, s in enumerate(t.text):
        if s == ":=" and t.at(i - 1) == "_" and t.at(i - 2) == "," and t.kind[i + 1 : i + 2] == ["name"]:
            end, name = _chain(t, i + 1)
            while t.at(end + 1) == "(" and t.at(t.match[end + 1] + 1) == ".":  # f().g()
                end, name = _chain(t, t.match[end + 1] + 2)
            if t.at(end + 1) == "(" and (name in FAILING or name.endswith(("Err", "Error", "WithError"))):
                yield t.line[i], name, f"the error of {name}() is dropped"


def go_bare_recover(t: Tokens) -> Found:
    for i, s in enumerate(t.text):
        if s == "defer" and t.at(i + 1) == "func" and t.at(i + 2) == "(":
            k = t.match[i + 2] + 1
            if t.at(k) == "{" and t.text[k + 1 : t.match[k]] in (["recover", "(", ")"], ["recover", "(", ")", ";"]):
                yield t.line[i], "recover()", "every panic is swallowed"


def go_unchecked_assertion(t: Tokens) -> Found:
    """v := x.(T) with one value to the left, which panics if x is no T."""
    for i, s in enumerate(t.text):
        if s == "." and t.at(i + 1) == "(" and t.at(i + 2) != "type":
            k = i - 1
            while k >= 0 and (t.kind[k] == "name" or t.text[k] in (".", ")", "]")) and t.line[k] == t.line[i]:
                k = t.match[k] - 1 if k in t.match else k - 1
            end = t.match[i + 1] + 1
            if k > 0 and t.text[k] in (":=", "=") and t.at(k - 2) != "," and (end == len(t.text) or t.line[end] > t.line[end - 1] or t.text[end] in (";", "}")):
                name = t.text[i + 2] if t.match[i + 1] == i + 3 else ""
                yield t.line[k], f".({name})", f"panics unless the value is a {name or 'value of that type'}"


def go_goroutine_no_sync(t: Tokens) -> Found:
    for i, s in enumerate(t.text):
        if s == "go" and t.at(i + 1) == "func" and t.at(i + 2) == "(":
            k = t.match[i + 2] + 1
            while k < len(t.text) and t.text[k] != "{":
                k += 1
            if k < len(t.text) and not any(h in " ".join(x for x, kind in zip(t.text[k : t.match[k]], t.kind[k : t.match[k]]) if kind == "name") for h in SYNC):
                yield t.line[i], "go func()", "nothing waits for it or ends it"


TS_RULES: dict[str, Callable[[Tokens], Found]] = {"missing_await": ts_missing_await, "optional_dereference": ts_optional_dereference, "bare_except": ts_empty_catch, "unvalidated_lookup_chain": ts_unvalidated_lookup_chain, "llm_response_unguarded": ts_llm_response_unguarded}
GO_RULES: dict[str, Callable[[Tokens], Found]] = {f.__name__: f for f in (go_ignored_error, go_bare_recover, go_unchecked_assertion, go_goroutine_no_sync)}


def check_text(file: str, text: str | None) -> list[tuple[int, str, str, str]]:
    """(line, mode, call, message) of one file, each (line, mode, call) once, in order; Go tests and other suffixes give none."""
    rules = TS_RULES if file.endswith(SCRIPT) else GO_RULES if file.endswith(GO) and not file.endswith("_test.go") else {}
    t = tokens(text or "") if rules else None
    if t is None:
        return []
    out: dict[tuple, str] = {}
    for mode, rule in rules.items():
        for line, call, message in rule(t):
            out.setdefault((line, mode, call), message)
    return [(*k, m) for k, m in sorted(out.items())]


def check(files: DataFrame) -> DataFrame:
    """files(file, text): violations (file, line, mode, call, message)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, *r) for f, t in zip(b["file"], b["text"]) for r in check_text(f or "", t)], columns=["file", "line", "mode", "call", "message"])

    return files.select("file", "text").mapInPandas(run, SCHEMA)
