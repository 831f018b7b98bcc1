"""Command line: generate, analyze, resume, apply. Exit codes: 0 done, 1 other errors, 2 usage, 3 the model failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import generate, model


def instructions(text: str) -> str:
    """Inline text, ``@file``, or ``-`` for standard input."""
    if text == "-":
        return sys.stdin.read()
    if text.startswith("@"):
        with open(text[1:], encoding="utf-8") as f:
            return f.read()
    return text


def main(argv: list[str] | None = None, backend: model.Backend | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sluicework")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("generate", "analyze", "resume", "apply"):
        p = verbs.add_parser(verb)
        p.add_argument("file", help="the state file for resume, else the data")
        if verb in ("generate", "analyze"):
            p.add_argument("-i", "--instructions", default="")
            p.add_argument("--chunk-size", type=int)
            p.add_argument("--mode", default="auto", choices=("auto", "structured", "text"))
            p.add_argument("--state-file")
            p.add_argument("--sampling", default="sequential", choices=("sequential", "random", "stratified"))
            p.add_argument("--stratify-field")
            p.add_argument("--auto-parse", action="store_true", help="have the model write a parser for an unknown suffix")
        if verb == "apply":
            p.add_argument("-f", "--functions", required=True)
            p.add_argument("--parser", help="a file with the parser of the data")
            p.add_argument("--evolve", action="store_true", help="let rules add fields and change types")
        else:
            p.add_argument("--model", default="default")
            p.add_argument("--base-url", default="http://localhost:8000/v1")
        if verb in ("generate", "apply"):
            p.add_argument("-o", "--output")
    try:
        a = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = SparkSession.builder.appName("sluicework").getOrCreate()
    try:
        if a.verb == "apply":
            parser_code = instructions(f"@{a.parser}") if a.parser else ""
            print(generate.apply_module(spark, a.file, a.functions, a.output, a.evolve, parser=parser_code))
            return 0
        used = backend or model.Http(a.model, a.base_url)
        if a.verb == "resume":
            runner = generate.Cleaner.resume(spark, a.file, used)
        else:
            more = {"output_path": a.output} if getattr(a, "output", None) else {}
            runner = generate.Cleaner(spark, generate.Config(a.file, instructions(a.instructions), a.mode, a.chunk_size, state_file=a.state_file, dry_run=a.verb == "analyze", sampling=a.sampling, stratify_field=a.stratify_field, auto_parse=a.auto_parse, **more), used, print)
        runner.run()
    except (OSError, TimeoutError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
