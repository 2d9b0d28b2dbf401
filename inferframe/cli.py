"""Command line: chat, ocr, schema, compare, export-text."""

from __future__ import annotations

import argparse
import os
import sys

from .operators.schema_export import TYPES, schema_text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inferframe", description="Runs prompts over tables with Spark.")
    p.add_argument("--version", action="version", version="inferframe 0.1")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("chat", "ocr"):
        c = sub.add_parser(name)
        c.add_argument("input", nargs="?", help="CSV or JSONL; standard input if left out")
        c.add_argument("-m", "--model", default="echo")
        c.add_argument("-p", "--prompt", required=name == "chat")
        c.add_argument("-o", "--out", default=None, help="folder of the result files; standard output if left out")
        c.add_argument("--models-url", default=None, help="proxy that lists models and prices; OPENAI_API_BASE if left out")
        c.add_argument("-j", "--jobs", type=int, default=8)
        c.add_argument("--limit", "--take-first", type=int, default=None)
        c.add_argument("--offset", type=int, default=0)
        c.add_argument("--allow-reordering", action="store_true")
        c.add_argument("--allowed-failure-rate", type=float, default=0.01)
        c.add_argument("--driver", default="echo", choices=("openai", "bedrock", "echo", "native", "vertex"))
        c.add_argument("--max-completion-tokens", type=int, default=None)
        c.add_argument("--temperature", type=float, default=None)
        c.add_argument("--top-p", type=float, default=None)
        c.add_argument("--timeout", type=float, default=None)
        c.add_argument("--rate-limit", default=None, help="like 10/s or 5/m")
        if name == "ocr":
            c.add_argument("--rasterize", action="store_true")
            c.add_argument("--rasterize-dpi", type=int, default=300)
            c.add_argument("--max-pages", type=int, default=None)
            c.add_argument("--include-page-breaks", action="store_true")
    c = sub.add_parser("schema")
    c.add_argument("type", choices=TYPES)
    c.add_argument("--inline", action="store_true")
    c.add_argument("-o", "--out", default=None)
    c = sub.add_parser("compare")
    c.add_argument("input")
    c.add_argument("--column1", required=True)
    c.add_argument("--column2", required=True)
    c.add_argument("-o", "--out", default=None, help="folder of the result files; standard output if left out")
    c = sub.add_parser("export-text")
    c.add_argument("input")
    for option in ("--key", "--new-key", "--path-pattern"):
        c.add_argument(option, required=True)
    c.add_argument("-o", "--out", default=None, help="folder of the result files; standard output if left out")
    c = sub.add_parser("finish", help="write results that a run made but couldn't write")
    c.add_argument("kept", help="the folder that its error named")
    c.add_argument("-o", "--out", default=None)
    c.add_argument("--allow-reordering", action="store_true")
    c.add_argument("--allowed-failure-rate", type=float, default=0.01)
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "schema":
        text = schema_text(args.type, args.inline)
        if args.out:
            with open(args.out, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
        return 0
    from pyspark.sql import SparkSession

    from .operators.chat import ResultsKept, RunOptions, chat, finish_results, run_and_write
    from .operators.metrics import FailureRateError
    from .operators.models import fetch_models
    from .operators.ocr import ocr
    from .operators.prompt import PromptError
    from .operators.providers import LlmOptions
    from .operators.schema import SchemaError
    from .operators.similarity import compare_paths
    from .sources.files import PageOptions
    from .sources.records import export_text, json_lines, print_csv, spool, write_csv

    spark = SparkSession.builder.appName("inferframe").config("spark.speculation", "false").getOrCreate()
    if args.command == "compare":
        found = compare_paths(spark.read.csv(args.input, header=True, escape='"', multiLine=True), args.column1, args.column2)
        write_csv(found, args.out) if args.out else print_csv(found)
        return 0
    if args.command == "export-text":
        found = export_text(spark.read.json(args.input), "id", args.key, args.new_key, args.path_pattern)
        if args.out:
            found.write.mode("overwrite").json(args.out)
        else:
            for row in found.select(json_lines(found).alias("line")).toLocalIterator():
                print(row.line)
        return 0
    if args.command == "finish":
        run = RunOptions(allow_reordering=args.allow_reordering)
        try:
            summary = finish_results(spark, args.kept, args.out, run, csv=bool(args.out) and args.out.endswith(".csv"))
            summary.check(args.allowed_failure_rate)
        except (FailureRateError, ResultsKept) as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
        return 0
    run = RunOptions(args.jobs, args.offset, args.limit, args.allow_reordering, args.allowed_failure_rate)
    options = LlmOptions(args.max_completion_tokens, args.temperature, args.top_p, args.timeout, args.rate_limit)
    try:
        source = args.input or spool(spark)
        proxy = args.models_url or os.environ.get("OPENAI_API_BASE")
        models = fetch_models(spark, proxy, os.environ.get("OPENAI_API_KEY")) if proxy else None
        if args.command == "chat":
            summary = run_and_write(chat(source, args.prompt, args.driver, args.model, run, options, models, spark), args.out, run)
        else:
            pages = PageOptions(args.rasterize, args.rasterize_dpi, args.max_pages, args.include_page_breaks)
            rows = ocr(source, args.model, args.driver, args.prompt, pages, run, options, models, spark)
            summary = run_and_write(rows, args.out, run, csv=bool(args.out) and args.out.endswith(".csv"))
    except (FailureRateError, PromptError, ResultsKept, SchemaError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for line in summary.lines():
        print(line, file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
