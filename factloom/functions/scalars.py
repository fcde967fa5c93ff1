"""Column expressions that the rules and mining operators share; all stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

USER_WORDS = ("user", "input", "query", "prompt", "message", "request", "body", "payload", "content", "text")


def words(text: Column, pattern: str) -> Column:
    """Whether a pattern of words is found in text as RE2 finds it: only ASCII letters, digits and _ make words, and without case ſ is s and K is k."""
    pattern = pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
    if pattern.startswith("(?i)"):
        pattern = re.sub(r"(?<!\\)[sk]", lambda m: {"s": "[s\u017f]", "k": "[k\u212a]"}[m[0]], pattern)
    return text.rlike(pattern)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.]", "")


def is_test_file(path: Column) -> Column:
    name = basename(path)
    return name.startswith("test_") | name.endswith("_test.py") | name.isin("conftest.py", "test.py") | path.rlike(r"(^|/)(tests?|testing|unittest)/")


def is_production(path: Column) -> Column:
    s = stem(path)
    return ~(s.startswith("test_") | (s == "seed_corpus") | (s == "__main__"))


def is_user_named(name: Column, words: tuple[str, ...] = USER_WORDS) -> Column:
    return F.arrays_overlap(F.split(F.lower(name), "_"), F.array(*[F.lit(w) for w in words]))


def zone(instability: Column, abstractness: Column, distance: Column) -> Column:
    return (
        F.when((distance > 0.5) & (instability < 0.3) & (abstractness < 0.3), "pain")
        .when((distance > 0.5) & (instability > 0.7) & (abstractness > 0.7), "uselessness")
        .otherwise("main")
    )


def severity(context: Column, high: tuple[str, ...]) -> Column:
    return F.when(context.isin(*high), "high").otherwise("medium")


def coverage_level(has_record: Column, has_ticket: Column, has_tests: Column) -> Column:
    """Decision record 3, ticket 2, tests alone 1.5, nothing 0; tests lift a bare ticket no further."""
    return F.when(has_record, 3.0).when(has_ticket, 2.0).when(has_tests, 1.5).otherwise(0.0)


def fragility(fiedler: Column, components: Column) -> Column:
    return F.when(components > 1, "disconnected").when(fiedler < 0.05, "fragile").when(fiedler < 0.30, "moderate").otherwise("robust")


def loop_fitness(v: Column, a: Column, o: Column, f: Column, t: Column, p: Column, s: Column) -> Column:
    return 0.25 * v + 0.20 * a + 0.15 * o + 0.15 * f + 0.10 * t + 0.10 * p + 0.05 * s


def missing_or_message(missing: Column, message: Column) -> Column:
    """The fields an evidence names, or its message alone if it names none."""
    return F.when(F.size(missing) > 0, missing).otherwise(F.array(message))


def is_project_function(name: Column, *, stdlib: tuple[str, ...] = (), prefixes: tuple[str, ...] = ("_", "pytest")) -> Column:
    out = ~name.isin(*stdlib) if stdlib else F.lit(True)
    for p in prefixes:
        out = out & ~name.startswith(p)
    return out


def has_label(labels: Column, names: tuple[str, ...]) -> Column:
    """Whether any label, apart from case, blanks, hyphens and apostrophes, is one of the names; false for null or no labels."""
    same = lambda c: F.regexp_replace(F.lower(c), r"[\s'’_-]+", "")
    return F.coalesce(F.exists(labels, lambda x: same(x).isin(*names)), F.lit(False))


def too_long(value: Column, most: int) -> Column:
    return F.length(value) > most


def out_of_range(value: Column, *, low: float | None = None, high: float | None = None) -> Column:
    out = F.lit(False)
    if low is not None:
        out = out | (value < low)
    if high is not None:
        out = out | (value > high)
    return out


def not_a_choice(value: Column, choices: tuple) -> Column:
    return ~value.isin(*choices)
