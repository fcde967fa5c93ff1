"""Text and source scans. Rules on syntax trees run over SAMPLES, as no table holds code; their tests are tests/test_rules.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import constraints, rules
from factloom.plans.catalog import query
from factloom.plans.facts import Facts
from factloom.sources import python_facts, readers

SAMPLES = {
    "pkg/a.py": "import json\nimport requests\n\n\ndef load(text, seen=[]):\n    seen.append(text)\n    return json.loads(text)\n\n\ndef fetch(url):\n    return requests.get(url)\n",
    "pkg/b.py": "import asyncio\nimport subprocess\n\n\nasync def work():\n    asyncio.run(other())\n    work()\n\n\nasync def other():\n    try:\n        subprocess.run(['ls'])\n    except:\n        return '{} {}'.format(1)\n",
    "pkg/c.py": "def f(q, table, score):\n    row = q.objects.first()\n    key = table.get(row)\n    total = score or 0\n    return row.name, table[key], any([table[0], total])\n",
    "pkg/broken.py": "def (",
}


def samples(f: Facts) -> DataFrame:
    return f.spark.createDataFrame(sorted(SAMPLES.items()), "file string, text string")


@query("c00_check_samples")
def check_samples(f: Facts) -> DataFrame:
    return rules.check(samples(f)).select("file", "line", "mode", "call")


@query("src02_python_facts")
def python_sample_facts(f: Facts) -> DataFrame:
    return python_facts.facts(samples(f))


@query("c01_model_constraint", """WITH w AS (SELECT c.site, m.* FROM {site_creates} c JOIN {model_fields} m ON m.model = c.model WHERE m.field_type <> 'ManyToManyField'),
v AS (SELECT w.*, p.site IS NOT NULL AS given, p.text, p.number FROM w LEFT JOIN {site_values} p ON p.site = w.site AND p.field = w.field),
k AS (SELECT v.*, EXISTS (SELECT 1 FROM {field_choices} c WHERE c.model = v.model AND c.field = v.field AND c.text IS NOT NULL) AS some_text, EXISTS (SELECT 1 FROM {field_choices} c WHERE c.model = v.model AND c.field = v.field AND c.number IS NOT NULL) AS some_number,
  EXISTS (SELECT 1 FROM {field_choices} c WHERE c.model = v.model AND c.field = v.field AND c.text = v.text) AS ok_text, EXISTS (SELECT 1 FROM {field_choices} c WHERE c.model = v.model AND c.field = v.field AND c.number = v.number) AS ok_number FROM v)
SELECT site, field, 'missing' AS problem FROM k WHERE NOT given AND required UNION ALL SELECT site, field, 'too long' FROM k WHERE length(text) > max_length UNION ALL SELECT site, field, 'too small' FROM k WHERE number < min_value
UNION ALL SELECT site, field, 'too large' FROM k WHERE number > max_value UNION ALL SELECT site, field, 'no choice' FROM k WHERE (text IS NOT NULL AND some_text AND NOT ok_text) OR (number IS NOT NULL AND some_number AND NOT ok_number)""")
def model_constraint(f: Facts) -> DataFrame:
    return constraints.field_problems(f.site_creates, f.site_values, f.model_fields, f.field_choices)


@query("c02_required_arg_missing", """WITH u AS (SELECT name, min(func_id) AS func_id, bool_or(is_called_otherwise) AS o FROM {functions_called} GROUP BY name HAVING count(*) = 1),
n AS (SELECT u.name, a.arg, a.kwonly, sum(CASE WHEN a.kwonly THEN 0 ELSE 1 END) OVER (PARTITION BY u.name ORDER BY a.kwonly, a.pos) AS k FROM u JOIN {function_args} a ON a.func_id = u.func_id WHERE a.required AND NOT u.o),
x AS (SELECT name, max(CASE WHEN k = 1 AND NOT kwonly AND arg IN ('ctx', 'cgctx', 'context', 'typingctx', 'typingcontext') THEN 1 ELSE 0 END) AS context FROM n GROUP BY name)
SELECT c.seq, c.callee, n.arg FROM {calls_made} c JOIN n ON n.name = c.callee JOIN x ON x.name = c.callee
WHERE NOT c.spread AND NOT c.is_create AND NOT c.in_main AND NOT c.is_local AND (n.kwonly OR n.k > c.n_positional + CASE WHEN c.is_method OR x.context = 1 THEN 1 ELSE 0 END)
AND NOT EXISTS (SELECT 1 FROM {call_keywords} w WHERE w.seq = c.seq AND w.arg = n.arg)""")
def required_arg_missing(f: Facts) -> DataFrame:
    return constraints.required_args_missing(f.calls_made, f.call_keywords, f.functions_called, f.function_args)


@query("src05_python_calls", None)
def required_args_of_samples(f: Facts) -> DataFrame:
    """No SQL: facts of source text; tests know the rows."""
    t = python_facts.tables(python_facts.facts(samples(f)))
    return constraints.required_args_missing(t["calls"], t["call_keywords"], t["functions"], t["function_args"]).select("callee", "arg")


@query("src13_json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM {events} GROUP BY 1")
def json_props(f: Facts) -> DataFrame:
    return f.events.select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"))


@query("src16_links", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM {pages}) SELECT page_id, CAST(count(DISTINCT href) AS BIGINT) AS links FROM l GROUP BY page_id")
def links(f: Facts) -> DataFrame:
    return f.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).groupBy("page_id").agg(F.countDistinct("href").alias("links"))


@query("src19_notes", """WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {documents})
SELECT file, CAST(line AS INT) AS line, trim(text, ' ') AS text FROM l WHERE regexp_matches(text, '\\b(license|License|Copyright|token)\\b')""")
def notes(f: Facts) -> DataFrame:
    return readers.notes(f.documents.select(F.col("doc_id").alias("file"), "text"), tags=r"\b(license|License|Copyright|token)\b")


@query("snk3_mermaid", "SELECT 'flowchart LR' || chr(10) || string_agg('  ' || CAST(n_nationkey AS STRING) || ' --> ' || CAST(n_regionkey AS STRING), chr(10) ORDER BY '  ' || CAST(n_nationkey AS STRING) || ' --> ' || CAST(n_regionkey AS STRING)) AS text FROM {nation}")
def mermaid(f: Facts) -> DataFrame:
    return readers.mermaid(f.nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")))
