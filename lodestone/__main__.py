"""Command line over a store: refresh, usages, search, closure, declarations, summarize, prune.

Exit status: 0 done; 1 wrong usage or no such file; 2 git or the store failed, or a name is ambiguous; 3 nothing found (search, declarations).
"""

from __future__ import annotations

import argparse
import subprocess
import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import closure, corpus, declarations, display, search
from .sources.index_files import COLUMNS
from .streaming.refresh import Conflict, Store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        v.add_argument("--worktree", required=True)
        v.add_argument("--store", required=True)
        v.add_argument("--no-refresh", action="store_true")
        return v

    verb("refresh").add_argument("--force", action="store_true")
    verb("prune")
    u = verb("usages")
    u.add_argument("symbol")
    u.add_argument("--no-text", action="store_true")
    s = verb("search")
    s.add_argument("terms", nargs="+")
    s.add_argument("--top", type=int, default=search.TOP)
    for v in (u, s):
        v.add_argument("--scope")
        v.add_argument("--include", action="append")
    c = verb("closure")
    seeds = c.add_mutually_exclusive_group(required=True)
    for n in ("--scope", "--symbol", "--file"):
        seeds.add_argument(n)
    d = verb("declarations")
    for n in ("name", "container", "file", "project", "kind", "base", "attribute"):
        d.add_argument(f"--{n}")
    d.add_argument("--include-generated", action="store_true")
    d.add_argument("--group-by", choices=declarations.GROUPS)
    d.add_argument("--max-results", type=int, default=display.MAX_RESULTS)
    d.add_argument("--raw", action="store_true")
    p = verb("summarize")
    p.add_argument("path")
    p.add_argument("--head", type=int, default=40)
    p.add_argument("--tail", type=int, default=20)
    return top


def _print(rows: DataFrame, order: tuple[str, ...], row: Column) -> int:
    """Rows in an order, one partition at a time from the executors."""
    n = 0
    for r in display.ordered(rows, order).select(row.alias("row")).toLocalIterator():
        print(r.row)
        n += 1
    return n


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    store, began = Store(spark, args.store), time.time()
    if args.verb == "prune":
        print(f"prune: {store.prune()} contents dropped", file=sys.stderr)
        return 0
    report = store.refresh(args.worktree, force=getattr(args, "force", False), refresh=not args.no_refresh)
    for e in report.errors:
        print(f"parse-error\t{e}", file=sys.stderr)
    say = lambda text: print(f"{args.verb}: {text} | {1000 * (time.time() - began):,.0f} ms", file=sys.stderr)
    if args.verb == "refresh":
        say(f"{report.files} files, {report.read} read, {report.parsed} parsed" + (", nothing to do" if report.reused else ""))
        return 0
    lines, manifest = store.lines(args.worktree)
    if args.verb == "usages":
        found = search.usages(lines, manifest, args.symbol, args.scope, args.include)
        if args.no_text:
            found = found.withColumn("text", F.lit(None).cast("string"))
        n = _print(found, display.USAGES, display.usages_row())
        say(f"{n} references in {found.select('path').distinct().count()} files")
        return 0
    if args.verb == "search":
        n = _print(search.rank(lines, manifest, args.terms, args.scope, args.include, args.top), display.RANKED, display.ranked_row())
        say(f"{n} files")
        return 0 if n else 3
    if args.verb == "summarize":
        return summarize(store, manifest, lines, args)
    decl = store.declarations(args.worktree)
    if args.verb == "closure":
        seeds = closure.scope_seeds(decl, args.scope) if args.scope is not None else closure.operation_seeds(decl, args.symbol) if args.symbol else closure.file_seeds(decl, args.file)
        types, loaded, members = closure.close(decl, seeds)
        print("\t".join((*COLUMNS, "loaded")))
        n, m = (_print(t, display.CLOSURE, display.closure_row()) for t in (types, members.withColumn("loaded", F.lit(1))))
        say(f"types {n} (loaded {loaded.count()}), members {m}")
        return 0
    names = ("name", "container", "file", "project", "kind", "base", "attribute")
    found = declarations.find(decl, **{n: getattr(args, n) for n in names}, include_generated=args.include_generated)
    if found.isEmpty():
        print("No declaration found.")
        return 3
    if args.group_by:
        groups = declarations.group(found, args.group_by, ignore_case=True)
        row = F.concat_ws("\t", F.col("n").cast("string"), "key") if args.raw else F.format_string("  %6d  %s", "n", "key")
        _print(groups if args.raw else groups.limit(args.max_results), ("-n", "-key"), row)
        if not args.raw:
            print(f"\nTotal: {found.count()} declarations in {groups.count()} {args.group_by}s")
    elif args.raw:
        _print(found, ("file", "ord"), F.concat_ws("\t", *[F.col(c).cast("string") for c in COLUMNS]))
    else:
        shown = display.capped(found.withColumn("shown", declarations.displayed()), ["file", "line", "ord"], args.max_results)
        print("\n".join(display.grouped_by_file(shown)))
    return 0


def summarize(store: Store, manifest: DataFrame, lines: DataFrame, args: argparse.Namespace) -> int:
    """One file: by its path, else by its name alone if that is unique."""
    path = args.path.replace("\\", "/").removeprefix("./")
    low = F.lower("path")
    at = manifest.filter(low == path.lower()).limit(2).collect()
    at = at or manifest.filter((low == path.lower().split("/")[-1]) | low.endswith("/" + path.lower().split("/")[-1])).orderBy("path").limit(50).collect()
    if len(at) != 1:
        print(f"No such file: {args.path}" if not at else "\n".join(["Several files have that name:", *[f"  [{i}] {r.path}" for i, r in enumerate(at, 1)], "Give more of the path."]))
        return 2 if at else 1
    one = manifest.filter(F.col("path") == at[0].path)
    print("\n".join(display.preview_text(at[0].path, corpus.preview(one, store.blob(), lines, args.head, args.tail))))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    try:
        return run(spark, args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    except (Conflict, OSError, subprocess.CalledProcessError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
