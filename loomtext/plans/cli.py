"""Command line: ``python -m loomtext.plans.cli split|json|epub|chat``.

What an option does not say comes from a settings file (``--settings``, a JSON
object with the names of ``SETTINGS``), else from ``SETTINGS``.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from loomtext.operators.split import METHODS
from loomtext.plans import convert

#: Where and how to split if neither an option nor the settings file says: no input, parts of 50,000 words, no delimiters.
SETTINGS = {"input": "", "output_dir": "split_output", "method": "words", "value": convert.DEFAULT_WORDS, "delimiters": []}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomtext", description="Turn documents into text and cut text into parts.")
    kinds = p.add_subparsers(dest="kind", required=True)
    s = kinds.add_parser("split", help="cut a text file, or each file of a directory, into parts")
    s.add_argument("path", nargs="?")
    s.add_argument("-o", "--output-dir")
    one = s.add_mutually_exclusive_group()
    one.add_argument("-l", "--lines", type=int)
    one.add_argument("-b", "--bytes", type=int)
    one.add_argument("-n", "--parts", type=int)
    one.add_argument("-w", "--words", type=int)
    one.add_argument("-d", "--delimiter", nargs="+")
    s.add_argument("--at", nargs="+", default=None, metavar="DELIMITER", help="cuts by words: only where a section starts")
    s.add_argument("--settings", metavar="FILE", help=f"JSON object with any of {', '.join(SETTINGS)}")
    j = kinds.add_parser("json", help="string leaves of a JSON document, or of each one in a directory")
    j.add_argument("path")
    j.add_argument("output", nargs="?", help="text file of the one document")
    j.add_argument("--output-dir", help="folder of text files with the documents' names")
    e = kinds.add_parser("epub", help="text of an EPUB book, or of each one in a directory")
    e.add_argument("path")
    e.add_argument("-o", "--output", help="text file of the one book")
    e.add_argument("--output-dir", help="folder of text files with the books' names")
    c = kinds.add_parser("chat", help="messages of a chat export")
    c.add_argument("path")
    c.add_argument("-o", "--output-dir", default="chat_output")
    c.add_argument("-w", "--words", type=int, default=convert.DEFAULT_WORDS)
    c.add_argument("--base", default="chat_part", help="what the parts' names begin with")
    return p


def settings(path: str | None) -> dict:
    """SETTINGS, as far as the file doesn't say otherwise; a string of delimiters is one delimiter."""
    out = dict(SETTINGS)
    if path:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        if unknown := set(own) - set(SETTINGS):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= own
    if isinstance(out["delimiters"], str):
        out["delimiters"] = [out["delimiters"]]
    if out["method"] not in METHODS:
        raise ValueError(f"unknown method: {out['method']}")
    return out


def choose(args: argparse.Namespace, known: dict = SETTINGS) -> tuple[str, object]:
    """(method, value): the first option given in the order of METHODS, else as set; 0 counts as not given."""
    for method in METHODS:
        value = getattr(args, method)
        if value:
            return method, value
    return known["method"], known["delimiters"] if known["method"] == "delimiter" else known["value"]


def _target(path: str, output: str | None, folder: str | None) -> tuple[str, str | None]:
    """(folder, name): the output file's; else the folder that is named, or the source's own, and no name."""
    if output:
        return os.path.dirname(output) or ".", os.path.basename(output)
    return folder or (path if os.path.isdir(path) else os.path.dirname(path) or "."), None


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    try:
        if args.kind == "split":
            known = settings(args.settings)
            path = args.path or known["input"]
            if not path:
                raise ValueError("no input path")
        spark = SparkSession.builder.appName("loomtext").getOrCreate()
        if args.kind == "split":
            convert.split_path(spark, path, args.output_dir or known["output_dir"], *choose(args, known), delimiters=args.at or known["delimiters"])
        elif args.kind == "chat":
            parts = convert.convert_chat(spark, args.path, args.output_dir, args.words, args.base)
            print(f"{parts} parts in {args.output_dir}")
        else:
            getattr(convert, f"convert_{args.kind}")(spark, args.path, *_target(args.path, args.output, args.output_dir))
    except Exception as e:
        print(f"Error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
