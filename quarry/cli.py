"""Command line: `python -m quarry.cli <command>`."""

from __future__ import annotations

import argparse
import os
import sys

from quarry.plans import evaluate, tools
from quarry.plans.index import index_repo
from quarry.session import local_session
from quarry.sources.warehouse import Warehouse


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description="Index source trees and query them within a token budget.")
    top.add_argument("--warehouse", default=os.environ.get("QUARRY_WAREHOUSE", ".quarry"), help="Where the index is stored.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *positional: str, repo: bool = False, budget: bool = False, depth: bool = False):
        sub = commands.add_parser(name, help=text)
        for argument in positional:
            sub.add_argument(argument)
        if repo:
            sub.add_argument("--repo")
        if budget:
            sub.add_argument("--budget", type=int)
        if depth:
            sub.add_argument("--depth", type=int, default=2)
        return sub

    command("init", "Create the warehouse folders.")
    index = command("index", "Index a source tree.", "path", repo=True)
    index.add_argument("--only")
    index.add_argument("--force", action="store_true")
    search = command("search", "Search the index.", "query", repo=True, budget=True)
    search.add_argument("-k", type=int, default=8)
    search.add_argument("--scope")
    search.add_argument("--include-tests", action="store_true")
    search.add_argument("--no-graph", action="store_true")
    command("stats", "Show what is in the index.", repo=True)
    command("context", "Everything needed to change one symbol.", "name", repo=True, budget=True)
    command("what-breaks", "Callers, tests and co-changed files.", "name", repo=True, budget=True, depth=True)
    command("what-tests", "Tests that cover a symbol.", "name", repo=True, budget=True)
    command("why", "Who calls this, and how far up the chain.", "name", repo=True, budget=True, depth=True)
    command("outline", "A file's symbols and line ranges.", "path", repo=True, budget=True)
    command("repos", "List every indexed repository.")
    drop = commands.add_parser("drop", help="Remove indexed repositories.")
    drop.add_argument("names", nargs="+")
    drop.add_argument("-y", "--yes", action="store_true")
    demo = command("demo", "Index every subfolder of a tree as its own repository and score the golden set.", "path")
    demo.add_argument("--spec")
    score = command("eval", "Score golden questions.", "spec", repo=True)
    score.add_argument("--root", default=".")
    score.add_argument("--no-graph", action="store_true")
    return top


def _report(results) -> int:
    for r in results.collect():  # a row for each question of the set
        print(r.id, r.baseline_tokens, r.tokens, f"{r.saving:.2f}", f"{r.recall:.2f}", "ok" if r.passed else f"failed: {r.detail}", sep="\t")
    total = evaluate.summary(results)
    print(f"{total['passed']} of {total['questions']} passed; median saving {total['median_saving'] or 0:.0f}x over {total['measured']} with a baseline")
    return int(total["passed"] != total["questions"])


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or local_session(os.environ.get("QUARRY_CORES", "*"))
    warehouse = Warehouse(spark, args.warehouse)
    command = args.command
    if command == "init":
        warehouse.create()
        print(f"ready: {args.warehouse}")
        return 0
    if command == "index":
        print(index_repo(spark, warehouse, args.path, args.repo, args.only, args.force))
        return 0
    if command == "repos":
        for row in warehouse.repos().orderBy("repo").collect():
            counts = tools.repo_counts(warehouse, row["repo"])
            print(row["repo"], *counts.values(), "git" if row["has_history"] else "no git", str(row["indexed_at"])[:19], sep="\t")
        return 0
    if command == "drop":
        known = {r["repo"] for r in warehouse.repos().select("repo").collect()}
        for name in [n for n in args.names if n not in known]:
            print(f"not indexed, skipping: {name}")
        targets = [n for n in args.names if n in known]
        if targets and not args.yes and input(f"delete {', '.join(targets)}? [y/N] ").strip().lower() != "y":
            return 1
        for name in targets:
            warehouse.drop(name)
            print(f"dropped {name}")
        return 0 if targets else 1
    if command == "demo":
        for name in sorted(e.name for e in os.scandir(args.path) if e.is_dir() and not e.name.startswith(".")):
            print(index_repo(spark, warehouse, os.path.join(args.path, name), name, force=True))
        return _report(evaluate.run(spark, warehouse, evaluate.load_spec(args.spec), "", args.path)) if args.spec else 0
    try:
        repo = tools.choose_repo(warehouse, args.repo, os.path.basename(os.getcwd()))
    except LookupError as error:
        print(error, file=sys.stderr)
        return 1
    if command == "stats":
        status = tools.index_status(warehouse, repo)
        for key, value in (status or {"": f"nothing indexed under '{repo}'"}).items():
            print(key, value, sep="\t")
        return 0 if status else 1
    if command == "eval":
        spec = evaluate.load_spec(args.spec)
        return _report(evaluate.run(spark, warehouse, spec, repo, os.path.realpath(args.root), use_graph=not args.no_graph))
    ask = tools.Explorer(spark, warehouse, repo)
    pack = {
        "search": lambda: ask.search(args.query, args.k, args.scope, args.include_tests, not args.no_graph, args.budget),
        "context": lambda: ask.symbol_context(args.name, args.budget),
        "what-breaks": lambda: ask.what_breaks(args.name, args.depth, args.budget),
        "what-tests": lambda: ask.what_tests(args.name, args.budget),
        "why": lambda: ask.who_calls(args.name, args.depth, args.budget),
        "outline": lambda: ask.file_context(args.path, args.budget),
    }[command]()
    print(pack.render())
    print(f"~{pack.tokens()} tokens")
    return 0


if __name__ == "__main__":
    sys.exit(main())
