"""Command line: convert, inspect, usage, rows and formats over transcript files."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import inspect as summaries
from colloquy.operators import tool_calls, usage
from colloquy.plans import export
from colloquy.schema import CANONICAL
from colloquy.sources import scan
from colloquy.sources.detect import FORMATS


class Failure(Exception):
    """Ends a command with exit code 1."""


def _warn(text: str) -> None:
    print(f"warning: {text}", file=sys.stderr)


def _imported(spark: SparkSession, args, strict: bool = True) -> DataFrame:
    """The files' imported table; what was skipped is said. strict: a file that gives no conversation is a failure."""
    found = scan.read_transcripts(spark, args.inputs, args.format).cache()
    for r in scan.warnings(found).where("kind = 'disclosure'").collect():
        _warn(r["message"])
    if strict:
        bad = found.where("status <> 'ok'" if strict == "all" else "status in ('failed', 'no_conversation')").select("file", "error").first()
        if bad:
            raise Failure(f"{bad['file']}: {bad['error'] or 'no conversations found'}")
    return found


def convert(spark: SparkSession, args) -> int:
    if args.output and len(args.inputs) > 1:
        raise Failure("--output takes a single input file")
    found = _imported(spark, args, "all")
    bodies = export.export(found, args.to).orderBy("file", "conversation_ord").collect()
    for i, r in enumerate(bodies):
        text = r["body"] if args.to == "markdown" else export.pretty(r["body"])
        if args.output:
            path = export.numbered(args.output, i, len(bodies))
            with open(path, "w", encoding="utf-8") as f:
                f.write(text if text.endswith("\n") else text + "\n")
            print(f"wrote {path}", file=sys.stderr)
        else:
            if len(bodies) > 1:
                print(f"=== {r['file']} [{r['conversation_ord'] + 1}] ===", file=sys.stderr)
            print(text)
    return 0


def inspect(spark: SparkSession, args) -> int:
    rows = summaries.summaries(_imported(spark, args, "all")).orderBy("file", "conversation_ord").collect()
    for i, r in enumerate(rows):
        if len(rows) > 1:
            print(f"=== conversation {i + 1} ===")
        print(summaries.summary_text(r))
    return 0


def roll_up(spark: SparkSession, args) -> int:
    since = usage.window_start(args.window, int(time.time() * 1000))
    rolled = usage.usage(scan.messages(_imported(spark, args)), args.by, since)
    print(usage.usage_json(rolled) if args.json else usage.usage_table(rolled))
    return 0


def rows(spark: SparkSession, args) -> int:
    """A bad file is named and skipped; the exit code is 2 then. Files without a conversation are counted."""
    since = usage.window_start(args.window, int(time.time() * 1000))
    found = _imported(spark, args, strict=False)
    flat = tool_calls.tool_call_rows(found, since)
    lines = (tool_calls.rows_csv if args.csv else tool_calls.rows_jsonl)(flat).orderBy("_file_ord", "_file", "_conversation_ord", "_pos")
    if args.csv:
        print(tool_calls.csv_header())
    for r in lines.select("line").toLocalIterator():
        print(r["line"])
    state = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
    for r in found.where("status = 'failed'").select("file", "error").collect():
        _warn(f"{r['file']}: {r['error']}")
    if state.get("no_conversation"):
        _warn(f"{state['no_conversation']} input(s) contained no conversation to read")
    if state.get("failed"):
        _warn(f"{state['failed']} input(s) skipped")
    return 2 if state.get("failed") else 0


def formats(spark, args) -> int:
    print("Input formats (--from):", *(f"  {f}" for f in FORMATS), "", "Output formats (--to):", *(f"  {f}" for f in export.FORMATS), sep="\n")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="colloquy", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for name, run, text in (("convert", convert, "write conversations in another format"), ("inspect", inspect, "summarize files"), ("usage", roll_up, "token usage by model, day, conversation or source"), ("rows", rows, "one row a tool call, as JSON lines or CSV"), ("formats", formats, "list formats")):
        v = verbs.add_parser(name, help=text)
        v.set_defaults(run=run)
        if name == "formats":
            continue
        v.add_argument("inputs", nargs=1 if name == "inspect" else "+")
        v.add_argument("-f", "--from", dest="format", default="auto", choices=("auto", *FORMATS))
        if name == "convert":
            v.add_argument("-t", "--to", default=CANONICAL, choices=export.FORMATS)
            v.add_argument("-o", "--output")
        if name in ("usage", "rows"):
            v.add_argument("--window", help="the last N days, for example 30d")
        if name == "usage":
            v.add_argument("--by", default="model", choices=(*usage.DIMENSIONS, CANONICAL), help=f"{CANONICAL} is another word for conversation")
            v.add_argument("--json", action="store_true")
        if name == "rows":
            v.add_argument("--csv", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "formats":
        return formats(None, args)
    spark = spark or SparkSession.builder.appName("colloquy").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        return args.run(spark, args)
    except (Failure, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
