"""Command line: ``python -m factloom check DIR`` writes the findings of a source tree as JSON lines to a folder or, as a table, to the screen."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from factloom.operators import checking
from factloom.sources import readers


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("check", help="findings of a source tree")
    c.add_argument("root")
    c.add_argument("--out", help="folder for JSON; else they are printed")
    c.add_argument("--array", action="store_true", help="one JSON array instead of lines")
    c.add_argument("--semgrep", help="captured JSON report")
    c.add_argument("--mypy", help="captured JSON lines")
    c.add_argument("--changed", help="text file of the files to report on, one a line")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    files = readers.source_files(spark, a.root).unionByName(readers.script_files(spark, a.root)).unionByName(readers.go_files(spark, a.root))
    captures = tuple(read(spark, path, files) for read, path in ((readers.semgrep, a.semgrep), (readers.mypy, a.mypy)) if path)
    found = checking.check(files, captures=captures, changed=spark.read.text(a.changed).toDF("file") if a.changed else None).orderBy("file", "line", "mode", "call")
    if a.out:
        readers.write_violations(found, a.out, array=a.array)
    else:
        print(readers.comment(found).first()["text"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
