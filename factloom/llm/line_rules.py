"""Line-first cleaning: lines are judged one by one, then what is left of their text.

A line goes if it is blank or one of these holds, in this order:

* boilerplate: a licence, copyright, cookie or subscription notice, in any of the languages of PHRASES;
* navigation: entries set apart by bars, arrows or bullets, or a bare link;
* repetition, a kind of boilerplate: of ten words or more at most SAME are different;
* punctuation: symbols beyond SYMBOLS of its visible characters, exclamation marks in pairs again and
  again, or, for a line of at most FEW words, no sentence end in it.

The text is rejected if the lines that went held more than LOST of its visible characters, or if no
line is left. Everything is one projection and one filter of built-in expressions: no shuffle, no Python. The
lines are judged once, below a generator through which the filter isn't pushed; plain comparisons stand
before regular expressions, and no rule takes more than linear time in a line.

Defined cases: a null or empty text is rejected; a null id stays null; repeated rows are judged alike, and so
are several texts of one id; a very long line is one line; equal lines have equal verdicts; no rows, no texts;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS, FEW, SAME, LOST = 0.12, 3, 0.1, 0.5
PHRASES = (
    "all rights reserved", "licensed under", "creative commons", "cookie policy", "cookie settings", "privacy policy", "terms of use", "terms of service", "subscribe to", "sign up for", "copyright (c)", "copyright ©",
    "alle rechte vorbehalten", "tous droits réservés", "todos los derechos reservados", "datenschutzerklärung", "politique de confidentialité", "política de privacidad",
)
YEAR = r"copyright [0-9]{4}"
LICENCE = ("released under the ", " license")
NAVIGATION = r"(^\s*\||\|\s*$|\s\|\s|\s[>»›•·]\s.*\s[>»›•·]\s|^\s*(https?://|www\.)\S+\s*$)"
MARKED = r"[|>»›•·]|://|www\."  # what every line of navigation has
BLANK, SYMBOL, END, SHOUT = r"[ \t\n\r\f]", r"[#$%&*|<>{}\[\]\\^~=_+@/]", r"[.!?:;…。]", r"!!"
SHORT = r"^\s*\S+(\s+\S+){0,%d}\s*$" % (FEW - 1)


def visible(c: Column) -> Column:
    return F.length(c) - F.regexp_count(c, F.lit(BLANK))


def _boilerplate(low: Column) -> Column:
    found = F.contains(low, F.lit("copyright ")) & low.rlike(YEAR)
    for phrase in PHRASES:
        found = found | F.contains(low, F.lit(phrase))
    begin = F.call_function("locate", F.lit(LICENCE[0]), low)
    return found | ((begin > 0) & (F.call_function("locate", F.lit(LICENCE[1]), low, begin + F.lit(len(LICENCE[0]))) > 0))


def prepared(line: Column) -> Column:
    """What several rules look at, computed once."""
    return F.struct(line.alias("line"), F.lower(line).alias("low"), visible(line).alias("seen"), F.split(line, " ").alias("words"))


def fails(x: Column) -> Column:
    """Name of the rule that a prepared line breaks; null for a good line."""
    line, words = x["line"], x["words"]
    return (
        F.when(x["seen"] == 0, "blank")
        .when(_boilerplate(x["low"]), "boilerplate")
        .when(line.rlike(MARKED) & line.rlike(NAVIGATION), "navigation")
        .when((F.size(words) >= 10) & (F.size(F.array_distinct(words)) <= F.size(words) * F.lit(SAME)), "repetition")
        .when(F.regexp_count(line, F.lit(SYMBOL)) > x["seen"] * F.lit(SYMBOLS), "punctuation")
        .when(F.contains(line, F.lit("!!")) & (F.regexp_count(line, F.lit(SHOUT)) >= 2), "punctuation")
        .when(~line.rlike(END) & line.rlike(SHORT), "punctuation")
    )


def clean(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, kept_share) of the texts that stay, without their failed lines."""
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(whole, "\n", -1)
    good = F.filter(F.transform(lines, prepared), lambda x: fails(x).isNull())
    judged = F.struct(visible(whole).alias("seen"), F.size(lines).cast("long").alias("n_lines"), good.alias("good"))
    held = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(F.array(judged)))
    held = held.select("doc_id", F.inline(F.array(F.struct("seen", "n_lines", (F.col("n_lines") - F.size("good")).alias("n_removed"), F.array_join(F.col("good.line"), "\n").alias("text")))))
    held = held.select("doc_id", "text", "seen", "n_lines", "n_removed", visible(F.col("text")).alias("left"))
    return held.where((F.col("seen") > 0) & (F.col("text") != "") & (F.col("left") >= F.col("seen") * F.lit(1 - LOST))).select("doc_id", "text", "n_lines", "n_removed", F.round(F.col("left") / F.col("seen"), 6).alias("kept_share"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VISIBLE = "length(regexp_replace({}, '[ \\t\\n\\r\\f]+', '', 'g'))"
_PHRASES = " OR ".join(f"contains(lower(x), {_sql(p)})" for p in PHRASES)
OP7_SQL = rf"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, {_VISIBLE.format("t")} AS seen, len(ls) AS n_lines,
  list_filter(ls, lambda x: {_VISIBLE.format("x")} > 0 AND NOT ({_PHRASES}) AND NOT regexp_matches(lower(x), '{YEAR}|{LICENCE[0]}.*{LICENCE[1]}') AND NOT regexp_matches(x, {_sql(NAVIGATION)})
    AND NOT (len(string_split(x, ' ')) >= 10 AND len(list_distinct(string_split(x, ' '))) <= len(string_split(x, ' ')) * {SAME})
    AND len(regexp_extract_all(x, '[#$%&*|<>{{}}\[\]\^~=_+@/]')) <= {_VISIBLE.format("x")} * {SYMBOLS}
    AND len(regexp_extract_all(x, '{SHOUT}')) < 2
    AND NOT (len(regexp_extract_all(x, '\S+')) <= {FEW} AND NOT regexp_matches(x, '[.!?:;…。]'))) AS good FROM l),
k AS (SELECT doc_id, seen, n_lines, n_lines - len(good) AS n_removed, array_to_string(good, chr(10)) AS text FROM g)
SELECT doc_id, text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, round(CAST({_VISIBLE.format("text")} AS DOUBLE) / seen, 6) AS kept_share
FROM k WHERE seen > 0 AND text <> '' AND {_VISIBLE.format("text")} >= seen * {1 - LOST}
"""
