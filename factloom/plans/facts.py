"""Facts about code and its history, bound to the driver's tables, in SQL that Spark and DuckDB both read.

Every fact covers whole tables: orders stand for call sites, modules and functions of a customer's history,
parts for functions in files, line items for calls, commits and imports.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.iterate import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_SHORT = "'f' || CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING) || CASE WHEN p_size > 25 THEN 'a' ELSE 'b' END"

FACTS: dict[str, str] = {
    # call sites, models, fields
    "site_creates": "SELECT o_orderkey AS site, o_orderpriority AS model FROM {orders}",
    "model_req": """SELECT m.model, l.field FROM (SELECT DISTINCT o_orderpriority AS model FROM {orders}) m
        CROSS JOIN (SELECT DISTINCT l_linenumber AS field FROM {lineitem}) l WHERE l.field <= CAST(substr(m.model, 1, 1) AS INT)""",
    "site_provides": "SELECT l_orderkey AS site, l_linenumber AS field FROM {lineitem}",
    # functions and calls
    "functions": f"""SELECT p_partkey AS func_id, 'pkg' || CAST(p_size AS STRING) || '/' || CASE WHEN p_type = 'PROMO' THEN 'test_' ELSE '' END || 'm' || substr(p_brand, 7) || '.py' AS file,
        p_partkey AS line, p_brand || '.' || {_SHORT} AS name, {_SHORT} AS short FROM {{part}}""",
    "calls": """SELECT l.l_orderkey * 10 + l.l_linenumber AS seq, c.file, c.line + l.l_linenumber AS line, CASE WHEN l.l_discount = 0 THEN NULL ELSE c.name END AS caller,
        CASE WHEN l.l_returnflag = 'R' THEN 'ext.s' || CAST(l.l_suppkey AS STRING) WHEN l.l_returnflag = 'A' THEN f.short ELSE f.name END AS callee,
        CAST(l.l_quantity AS INT) % 4 AS n_positional
        FROM (SELECT *, l_orderkey % (SELECT count(*) FROM {part}) AS callee_id FROM {lineitem}) l JOIN {functions} c ON l.l_partkey = c.func_id JOIN {functions} f ON l.callee_id = f.func_id""",
    # arguments of functions, and what calls give: flags by the parts' sizes and the lines' numbers
    "functions_called": "SELECT func_id, name, func_id % 13 = 0 AS is_called_otherwise FROM {functions}",
    "function_args": """SELECT f.func_id, k.pos, CASE WHEN k.pos = 1 AND f.func_id % 11 = 0 THEN 'ctx' ELSE 'a' || CAST(k.pos AS STRING) END AS arg, (f.func_id + k.pos) % 3 <> 0 AS required, k.pos > 4 AS kwonly
        FROM {functions} f JOIN (SELECT DISTINCT l_linenumber AS pos FROM {lineitem}) k ON k.pos <= f.func_id % 8""",
    "calls_made": """SELECT seq, callee, n_positional, seq % 17 = 0 AS spread, seq % 19 = 0 AS is_create, contains(callee, '.') AND seq % 5 = 0 AS is_method, seq % 23 = 0 AS in_main, seq % 29 = 0 AS is_local FROM {calls}""",
    "call_keywords": "SELECT c.seq, 'a' || CAST(k.pos AS STRING) AS arg FROM {calls} c JOIN (SELECT DISTINCT l_linenumber AS pos FROM {lineitem}) k ON (c.seq + k.pos) % 4 = 0",
    # fields of models with bounds and choices, and the values that sites give: texts in odd fields, numbers in even ones
    "model_fields": """SELECT m.model, l.field, l.field <= CAST(substr(m.model, 1, 1) AS INT) AS required, CASE WHEN l.field = 7 THEN 'ManyToManyField' ELSE 'CharField' END AS field_type, CASE WHEN l.field = 1 THEN 0 ELSE 5 END AS max_length, 5 AS min_value, 40 AS max_value
        FROM (SELECT DISTINCT o_orderpriority AS model FROM {orders}) m CROSS JOIN (SELECT DISTINCT l_linenumber AS field FROM {lineitem}) l""",
    "field_choices": "SELECT model, field, CASE WHEN field % 2 = 1 THEN x.flag END AS text, CASE WHEN field % 2 = 0 THEN CAST(x.n AS BIGINT) END AS number FROM {model_fields} CROSS JOIN (SELECT DISTINCT l_returnflag AS flag, l_linenumber * 7 AS n FROM {lineitem} WHERE l_returnflag <> 'N') x WHERE field > 2",
    "site_values": "SELECT l_orderkey AS site, l_linenumber AS field, CASE WHEN l_linenumber % 2 = 1 AND l_discount > 0.02 THEN l_returnflag END AS text, CASE WHEN l_linenumber % 2 = 0 AND l_discount > 0.02 THEN CAST(l_quantity AS BIGINT) END AS number FROM {lineitem}",
    # a sparse graph: each order calls the customer's next one, and, if fulfilled, the one before
    "edges": """SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM {orders}) a WHERE dst IS NOT NULL
        UNION SELECT src, dst FROM (SELECT o_orderkey AS src, CASE WHEN o_orderstatus = 'F' THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS dst FROM {orders}) b WHERE dst IS NOT NULL""",
    "dag": """SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM {orders}) a WHERE dst IS NOT NULL
        UNION SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM {orders}) b WHERE dst IS NOT NULL""",
    "urgent": "SELECT o_orderkey AS node FROM {orders} WHERE o_orderpriority = '1-URGENT'",
    "pending": "SELECT o_orderkey AS node FROM {orders} WHERE o_orderstatus = 'P'",
    "order_functions": "SELECT o_orderkey AS node, o_totalprice > 100000 AS is_public FROM {orders}",
    # commits
    "commit_files": """SELECT DISTINCT l.l_orderkey AS sha, p.p_brand AS path, o.o_orderpriority AS author, CAST(o.o_orderdate AS DATE) AS day
        FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    "series": "SELECT p.p_brand AS path, l.l_orderkey * 10 + l.l_linenumber AS idx, max(l.l_quantity) AS value FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey GROUP BY 1, 2",
    "blame": "SELECT p.p_brand AS path, l.l_orderkey AS intro_sha FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey WHERE l.l_returnflag = 'R'",
    # corpus and imports
    "corpus": """SELECT n.n_name AS repo, CAST(floor(o.o_totalprice) AS BIGINT) AS stars, o.o_orderstatus || o.o_orderpriority AS mode, o.o_custkey AS file, o.o_orderkey AS seq
        FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    "repo_imports": """SELECT n.n_name AS repo, m.n_name AS pkg, m.n_name AS owner FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
        JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} m ON s.s_nationkey = m.n_nationkey""",
    "module_imports": """SELECT 'o' || CAST(src AS STRING) AS module, 'o' || CAST(dst AS STRING) AS target FROM {edges}
        UNION ALL SELECT 'o' || CAST(l_orderkey AS STRING), 'ext' || CAST(l_suppkey AS STRING) || '.sub' FROM {lineitem}""",
    "modules": """SELECT 'o' || CAST(o.o_orderkey AS STRING) AS module, count(l.l_orderkey) AS classes, count(CASE WHEN l.l_returnflag = 'A' THEN 1 END) AS abstract
        FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""",
    "stdlib": "SELECT 'ext' || CAST(s_suppkey AS STRING) AS pkg FROM {supplier} WHERE s_acctbal < 0",
    # runtime observations: a function is an order priority
    "observations": "SELECT o_orderpriority AS function, o_orderkey AS obs, o_totalprice AS result, o_orderstatus = 'P' AS raised, CASE WHEN o_orderpriority < '3' THEN o_custkey % 5 END AS size FROM {orders}",
    "arguments": """SELECT o_orderpriority AS function, o_orderkey AS obs, 'price' AS arg, o_totalprice AS value, false AS holds FROM {orders}
        UNION ALL SELECT o_orderpriority, o_orderkey, 'half', o_totalprice / 2, o_orderpriority > '2' FROM {orders} UNION ALL SELECT o_orderpriority, o_orderkey, 'cust', CAST(o_custkey AS DOUBLE), o_totalprice > 2000 FROM {orders}""",
    # subjects of commits: of a conversation as a file
    "subjects": """SELECT conv_id AS file, conv_id * 100 + turn AS idx, CASE WHEN turn % 3 = 0 THEN 'Always ' WHEN contains(text, 'on') THEN 'fix(core): ' WHEN contains(text, 'e') THEN 'Revert, then restore ' ELSE 'verify ' END || text AS subject FROM {conversations}""",
    # points and definitions in a file, by time
    "definitions": "SELECT user_id AS file, ts AS line, 'fn' || CAST(event_id AS STRING) AS name FROM {events} WHERE event_type = 'signup'",
    "points": "SELECT user_id AS file, ts AS line, event_id AS id FROM {events} WHERE event_type = 'error'",
    # scores by step of a loop: a customer's orders
    "states": "SELECT o_custkey AS loop, o_orderkey AS step, o_totalprice / 500000 AS fitness, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS fixed FROM {orders}",
    "violations": "SELECT p_size AS file, p_partkey AS line, p_type AS mode, p_brand AS call FROM {part}",
    "violations_b": "SELECT p_size AS file, p_partkey AS line, CASE WHEN p_retailprice > 1000 THEN p_type ELSE 'OTHER' END AS mode, p_brand AS call FROM {part}",
}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in Formatter().parse(text) if f))


class Facts:
    """Tables and facts of one directory as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._held: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._held:
            if name in TABLES:
                self._held[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in FACTS:
                self._held[name] = self.spark.sql(FACTS[name], **{x: getattr(self, x) for x in _names(FACTS[name])})
            else:
                raise AttributeError(name)
        return self._held[name]


def commit_paths(f: Facts) -> DataFrame:
    """(sha, path) of ``commit_files``, repeats and all, by joins whose tasks have no more rows in a larger input."""
    lines = f.lineitem.select(F.col("l_orderkey").alias("sha"), "l_partkey")
    n = lines.count()
    part = spread(f.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("path")), n, "l_partkey")
    orders = spread(f.orders.select(F.col("o_orderkey").alias("sha")), n, "sha")
    return spread(spread(lines, n, "l_partkey").join(part, "l_partkey").select("sha", "path"), n, "sha").join(orders, "sha", "left_semi")


def with_facts(sql: str) -> str:
    """DuckDB SQL in which ``{name}`` is a table or fact; the facts it needs come first, as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _names(text):
            if n in FACTS and n not in order:
                need(FACTS[n])
                order.append(n)

    need(sql)
    plain = lambda text: text.format(**{n: n for n in _names(text)})
    body = plain(sql).strip()
    if not order:
        return body.replace("WITH ", "WITH RECURSIVE ", 1) if body.startswith("WITH ") else body
    head = "WITH RECURSIVE " + ", ".join(f"{n} AS ({plain(FACTS[n])})" for n in order)
    return f"{head}, {body[5:]}" if body.startswith("WITH ") else f"{head} {body}"
