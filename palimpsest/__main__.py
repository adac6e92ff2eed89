"""Command line: ``python -m palimpsest -r FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .operators.topology import read_config
from .plans.repository import Repository, find_root
from .session import build_session


#: Seconds after which a command takes another one's open transaction or half-written file for abandoned.
STALE = 3600.0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    top.add_argument("-r", "--root", default=".", help="the repository's folder or one below it, at any path that Spark reaches")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, about: str, *arguments: tuple) -> None:
        command = commands.add_parser(name, help=about)
        for names, options in arguments:
            command.add_argument(*names, **options)

    branch, out = (["branch"], {"nargs": "?", "default": "main"}), (["-o", "--out"], {"required": True})
    add("init", "create a repository")
    add("commit", "commit a checkpoint file", (["path"], {}), (["-m", "--message"], {"default": ""}), (["-b", "--base"], {}), (["-a", "--author"], {"default": ""}), (["--config"], {}))
    add("checkout", "move to a branch or commit, and write its file", (["name"], {}), (["-o", "--out"], {}))
    add("branch", "list branches, or set one to the current commit", (["name"], {"nargs": "?"}), (["--ff-only"], {"action": "store_true"}))
    add("log", "list commits", (["name"], {"nargs": "?"}))
    add("verify", "check all reachable objects", (["name"], {"nargs": "?"}))
    add("merge", "merge a branch into the current one", (["source"], {}), (["-m", "--message"], {}))
    add("rebasin", "bring model b into a's order and mix the two", (["a"], {}), (["b"], {}), out, (["--alpha"], {"type": float, "default": 0.5}), (["--config"], {}))
    add("push", "send a branch to another repository", (["remote"], {}), branch)
    add("pull", "fetch a branch of another repository", (["remote"], {}), branch)
    add("recover", "close the transactions of crashed writers")
    add("ls", "list a commit's files", (["name"], {"nargs": "?"}))
    add("read", "write a byte range of a commit's file to standard output", (["name"], {}), (["offset"], {"type": int}), (["size"], {"type": int}))
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = spark or build_session()
    root = args.root if args.command in ("init", "rebasin") else find_root(spark, os.path.abspath(args.root) if "://" not in args.root and not args.root.startswith("file:") else args.root)
    if root is None:
        print(f"no repository at {args.root} or above", file=sys.stderr)
        return 2
    repo = Repository(spark, root)
    if args.command not in ("init", "rebasin", "recover"):
        repo.recover(STALE)
    if args.command == "init":
        repo.init()
    elif args.command == "commit":
        done = repo.commit(args.path, args.message, args.base, args.author, read_config(spark, args.config) if args.config else None)
        print(done.commit_id, json.dumps(done.statistics))
    elif args.command == "checkout":
        print(repo.checkout(args.name, args.out))
    elif args.command == "branch" and args.name:
        repo.branch(args.name, args.ff_only)
    elif args.command == "branch":
        current = repo.head()[0]
        print("\n".join(f"{'*' if name == current else ' '} {name}" for name in repo.branches()))
    elif args.command == "log":
        for row in repo.log(args.name).toLocalIterator():
            print(f"{row['commit_id'][:12]} {row['at']} {row['author']} {row['message']}")
    elif args.command == "verify":
        report = repo.verify(args.name)
        print(json.dumps(report))
        return 0 if report["is_valid"] else 1
    elif args.command == "merge":
        print(*repo.merge(args.source, args.message))
    elif args.command == "rebasin":
        repo.rebasin(args.a, args.b, args.out, args.alpha, read_config(spark, args.config) if args.config else None)
    elif args.command == "recover":
        print(json.dumps(repo.recover()))
    elif args.command in ("push", "pull"):
        print(getattr(repo, args.command)(Repository(spark, args.remote), args.branch))
    elif args.command == "ls":
        for name, size in repo.listing(args.name):
            print(size, name)
    elif args.command == "read":
        file = repo.open(repo._resolve(args.name))
        file.seek(args.offset)
        sys.stdout.buffer.write(file.read(args.size))
    return 0


if __name__ == "__main__":
    sys.exit(main())
