"""Command line: ``python -m latchgraph check [PATHS] [options]``."""

from __future__ import annotations

import argparse
import sys

from .names import TOOL
from .operators.render import FORMATS, ordered_pieces
from .plans.analyze import Options, analyze
from .session import build
from .sources.config import SEVERITIES, STRATEGIES


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog=TOOL)
    check = out.add_subparsers(dest="command", required=True).add_parser("check", help="find blocking calls reachable from async functions")
    check.add_argument("paths", nargs="*", default=["."])
    check.add_argument("--config")
    check.add_argument("--output", choices=sorted(FORMATS))
    check.add_argument("--intervention-strategy", choices=STRATEGIES)
    check.add_argument("--severity", choices=SEVERITIES)
    check.add_argument("--no-cache", action="store_true")
    check.add_argument("--clear-cache", action="store_true")
    check.add_argument("--first-party", default="", help="accepted, has no effect")
    check.add_argument("--python-version")
    check.add_argument("-q", "--quiet", action="store_true")
    check.add_argument("-v", "--verbose", action="count", default=0)
    return out


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = build(master=None)
    if not a.verbose:
        spark.sparkContext.setLogLevel("ERROR")
    options = Options(config=a.config, intervention_strategy=a.intervention_strategy, severity=a.severity, output_format=a.output, python_version=a.python_version, cache_enabled=False if a.no_cache else None, clear_cache=a.clear_cache)
    out = analyze(spark, a.paths, options)
    for error in out.errors.values():
        print(f"error: {error}", file=sys.stderr)
    if out.formats:
        kind = a.output or next(iter(out.formats.values()))
        if not (a.quiet and kind == "text" and not any(out.exit_codes[root] for root in out.formats)):
            # reports of several paths one after the other, each in its own order
            for r in ordered_pieces(out.pieces(kind, together=True)).toLocalIterator():
                print(r["text"])
    return out.exit_code


if __name__ == "__main__":
    sys.exit(main())
