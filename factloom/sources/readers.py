"""Readers and writers: source trees, history, JSON captures, text scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars as fn

PRUNED = (".git", "venv", ".venv", "vendor", ".github", "_vendor", ".uv-cache", "migrations", ".mypy_cache", ".ruff_cache", "__pycache__", "node_modules")
SCRIPT_PRUNED = ("out", ".nuxt", "build", ".next", "dist", *PRUNED)


def source_files(spark: SparkSession, root: str, *, suffixes: tuple[str, ...] = (".py",), pruned: tuple[str, ...] = PRUNED) -> DataFrame:
    """(file, text) of the files under root; pruned folders and backups are left out, undecodable bytes replaced.

    Only files of these suffixes are read: the pattern is applied to the listing. Pruned names count anywhere in the path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    below = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    keep = ~below.rlike(r"(_|\.)backup\.[^./]+$")
    for p in pruned:
        keep = keep & ~F.contains(below, F.lit(f"/{p}/"))
    return raw.where(keep).select(below.alias("file"), F.decode("content", "UTF-8").alias("text"))


def script_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, text) of TypeScript and JavaScript files."""
    return source_files(spark, root, suffixes=(".cjs", ".js", ".jsx", ".mjs", ".ts", ".tsx"), pruned=SCRIPT_PRUNED)


def go_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, text) of Go files but for tests, vendored code, test data and hidden folders."""
    files = source_files(spark, root, suffixes=(".go",), pruned=("vendor", "testdata"))
    return files.where(~F.col("file").endswith("_test.go") & ~F.col("file").rlike(r"/\.[^/]+/"))


DOCS = ("readme", "architecture", "design", "contributing", "changelog", "roadmap")


def docs_scan(spark: SparkSession, root: str, *, stems: tuple[str, ...] = DOCS, folders: tuple[str, ...] = ("docs", "doc", "adr", "adrs"), most: int = 8000) -> DataFrame:
    """(rank, file, text): documents of a known stem first, then those in documents' folders; texts cut to ``most`` characters, as a report."""
    files = source_files(spark, root, suffixes=(".md", ".rst", ".txt"))
    stem = F.lower(F.regexp_extract("file", r"([^/]+)\.[^.]+$", 1))
    inside = F.lit(False)
    for x in folders:
        inside = inside | F.contains(F.lower("file"), F.lit(f"/{x}/"))
    rank = F.when(stem.isin(*stems), 0).when(inside, 1)
    return files.select(rank.alias("rank"), "file", F.substring("text", 1, most).alias("text")).where("rank is not null").orderBy("rank", "file")


ISSUE = "number long, title string, body string, state string, labels array<struct<name:string>>, author struct<login:string>, createdAt string, closedAt string, url string"


def issues(spark: SparkSession, path: str) -> DataFrame:
    """(number, title, body, state, labels, author, created, closed) of a captured list of issues or pull requests: one JSON array or JSON lines."""
    d = spark.read.schema(ISSUE).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    day = lambda c: F.to_date(F.substring(c, 1, 10))
    return d.select("number", "title", F.coalesce("body", F.lit("")).alias("body"), F.lower("state").alias("state"), F.transform("labels", lambda x: x["name"]).alias("labels"), F.col("author.login").alias("author"), day("createdAt").alias("created"), day("closedAt").alias("closed"))


#: Rules of the external scanner by the last part of their id.
SEMGREP_MODES = {
    "bare-except": "bare_except", "missing-await": "missing_await", "mutable-default-arg": "mutable_default_arg", "requests-timeout-not-set": "timeout_not_set",
    "json-loads-unguarded": "json_loads_unguarded", "llm-response-unguarded": "llm_response_unguarded", "queryset-last-none-dereference": "optional_dereference", "queryset-first-none-dereference": "optional_dereference",
}
_PLACE = "struct<line:int,col:int>"


def semgrep(spark: SparkSession, path: str, files: DataFrame, *, modes: dict[str, str] | None = None) -> DataFrame:
    """(file, line, mode, call, message) of a captured JSON report: findings of known rules, with the text of files(file, text) where they are.

    A finding that ends on another line takes its first line's rest; one on a line marked ``# noqa`` is left out, and
    a bare except whose whole body is ``raise``.
    """
    schema = f"results array<struct<check_id:string,path:string,start:{_PLACE},end:{_PLACE},extra:struct<message:string>>>"
    found = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("results").alias("r")).select(F.element_at(F.split("r.check_id", r"\."), -1).alias("rule"), F.col("r.path").alias("file"), "r.start", "r.end", F.col("r.extra.message").alias("message"))
    known = spark.createDataFrame(sorted((modes or SEMGREP_MODES).items()), "rule string, mode string")
    at = found.join(F.broadcast(known), "rule").join(files, "file", "left").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    line = F.coalesce(F.try_element_at("lines", F.col("start.line")), F.lit(""))
    one = F.col("start.line") == F.col("end.line")
    call = F.trim(F.when(one, F.substring(line, F.col("start.col"), F.col("end.col") - F.col("start.col"))).otherwise(F.substring(line, F.col("start.col"), F.length(line))))
    body = F.array_join(F.slice("lines", F.col("start.line"), F.greatest(F.lit(1), F.col("end.line") - F.col("start.line") + 1)), "\n")
    reraises = (F.col("mode") == "bare_except") & body.rlike(r"except\s*:\s*raise\s*$")
    return at.where(~line.rlike("#\\s*noqa") & ~reraises).select("file", F.col("start.line").alias("line"), "mode", call.alias("call"), "message").distinct()


def mypy(spark: SparkSession, path: str, files: DataFrame, *, root: str = "") -> DataFrame:
    """(file, line, mode, call, message) of captured JSON lines: attributes of what may be, or is, None. Vendored files and ``# noqa`` lines are left out."""
    d = spark.read.schema("file string, line int, end_line int, severity string, code string, message string").option("mode", "DROPMALFORMED").json(path)
    none = (F.col("code") == "union-attr") | ((F.col("code") == "attr-defined") & F.contains("message", F.lit('"None" has no attribute')))
    file = F.when(F.col("file").startswith("/") | (F.lit(root) == ""), F.col("file")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "file"))
    kept = d.where((F.col("severity") == "error") & none & (F.col("line") > 0)).withColumn("file", file).where(~F.concat(F.lit("/"), "file").rlike("/(_vendor|vendor|site-packages)/"))
    at = kept.join(files, "file", "left")
    last = F.greatest(F.col("line"), F.coalesce("end_line", "line"))
    marked = F.exists(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), F.col("line"), last - F.col("line") + 1), lambda x: F.contains(x, F.lit("# noqa")))
    return at.where(~marked).select("file", "line", F.lit("optional_dereference").alias("mode"), F.substring("message", 1, 80).alias("call"), F.substring(F.concat(F.lit("mypy ["), "code", F.lit("]: "), "message"), 1, 120).alias("message")).distinct()


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and call edges(src, dst) of one document with nodes and links."""
    d = spark.read.option("multiLine", "true").json(path)
    links = d.select(F.explode("links").alias("l")).where("l.context = 'call'").select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"))
    return d.select(F.explode("nodes").alias("n")).select("n.*"), links


def commit_log(lines: DataFrame) -> DataFrame:
    """lines(value) of a log with fields sha, author, day and subject split by 0x1f and then its files: (sha, author, day, subject, files)."""
    p = F.split("value", "\x1f")
    return lines.where(F.size(p) >= 4).select(p[0].alias("sha"), p[1].alias("author"), F.to_date(p[2]).alias("day"), p[3].alias("subject"), F.filter(F.slice(p, 5, 1 << 30), lambda x: x != "").alias("files"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, author, day, subject, files) of a written ``git log --name-only``, commits begun by NUL and fields set apart by 0x1f, files on lines of their own."""
    raw = spark.read.option("lineSep", "\x00").text(path)
    head, rest = F.split("value", "\n", 2)[0], F.split("value", "\n", 2)
    p = F.split(head, "\x1f")
    files = F.filter(F.transform(F.split(F.coalesce(F.get(rest, 1), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.where(F.size(p) >= 4).select(p[0].alias("sha"), p[1].alias("author"), F.to_date(F.substring(p[2], 1, 10)).alias("day"), p[3].alias("subject"), files.alias("files"))


MINED = "sha string, author string, date string, message string, files array<struct<path:string,complexity:double,added:long,deleted:long>>"


def mined_commits(spark: SparkSession, path: str) -> DataFrame:
    """(sha, author, day, path, complexity, added, deleted) of captured commits with measures of their files; Python files only."""
    d = spark.read.schema(MINED).option("mode", "DROPMALFORMED").json(path).select("sha", "author", F.to_date(F.substring("date", 1, 10)).alias("day"), F.explode("files").alias("f"))
    return d.select("sha", "author", "day", "f.*").where(F.col("path").endswith(".py"))


def imports_by_line(files: DataFrame, *, lines: int = 60) -> DataFrame:
    """files(file, text): (file, pkg), top-level packages that import lines among the first ``lines`` name."""
    line = files.select("file", F.explode(F.slice(F.split("text", "\n"), 1, lines)).alias("line"))
    return line.select("file", F.regexp_extract("line", r"^(?:import|from)\s+([A-Za-z_]\w*)", 1).alias("pkg")).where("pkg <> ''").distinct()


def notes(files: DataFrame, *, tags: str = r"\b(TODO|FIXME|HACK|XXX|NOTE)\b") -> DataFrame:
    """(file, line, text) of lines with a tag, from 1."""
    line = files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return line.where(fn.words(F.col("text"), tags)).select("file", (F.col("line") + 1).alias("line"), F.trim("text").alias("text"))


def changelog_lines(files: DataFrame, stem: str, *, most: int = 80) -> DataFrame:
    """The first ``most`` lines that name the stem or a fix."""
    line = files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return line.where(F.col("text").contains(stem) | fn.words(F.col("text"), r"(?i)\b(fix|bug|hotfix|patch)")).orderBy("file", "line").limit(most)


def write_violations(violations: DataFrame, path: str, *, mode: str = "overwrite", array: bool = False) -> None:
    """JSON lines; with ``array`` one JSON array, in one file, for readers of a report."""
    if not array:
        violations.write.mode(mode).json(path)
        return
    columns = violations.columns
    one = violations.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns)))).alias("value"))
    one.coalesce(1).write.mode(mode).text(path)


def comment(violations: DataFrame, *, most: int = 50) -> DataFrame:
    """One row: a Markdown table of the first ``most`` violations(file, line, mode, call), and how many there are."""
    row = F.concat(F.lit("| `"), "file", F.lit(":"), F.col("line").cast("string"), F.lit("` | "), "mode", F.lit(" | `"), F.coalesce("call", F.lit("")), F.lit("` |"))
    shown = violations.orderBy("file", "line", "mode", "call").limit(most).select(row.alias("l"), "file", "line", "mode", "call")
    lines = shown.agg(F.transform(F.array_sort(F.collect_list(F.struct("file", "line", "mode", "call", "l"))), lambda x: x["l"]).alias("ls"))
    return lines.crossJoin(violations.agg(F.count("*").alias("n"))).select(F.concat_ws("\n", F.concat(F.lit("### "), F.col("n").cast("string"), F.lit(" findings")), F.lit(""), F.lit("| Where | Mode | Call |"), F.lit("|-|-|-|"), F.array_join("ls", "\n")).alias("text"))


def mermaid(edges: DataFrame) -> DataFrame:
    """One row: the text of a flow chart, edges in order; for graphs that one page shows."""
    line = F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(" --> "), F.col("dst").cast("string"))
    return edges.select(line.alias("l")).agg(F.concat_ws("\n", F.lit("flowchart LR"), F.array_sort(F.collect_set("l"))).alias("text"))
