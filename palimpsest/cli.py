"""Command line: python -m palimpsest.cli COMMAND ...; prints JSON."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, Row, SparkSession

from palimpsest.functions.text import SPACE
from palimpsest.operators.reads import json_row
from palimpsest.sources import json_io
from palimpsest.sources.embedding import from_config
from palimpsest.sources.store import Store


def store_path(given: str | None) -> str:
    """The option, else the environment, else a folder in the home directory."""
    return given or os.environ.get("PALIMPSEST_DB") or os.path.join(os.path.expanduser("~"), ".palimpsest")


def content_of(words: list[str], stdin) -> str:
    """The arguments, or what is piped in; trimmed, and never blank."""
    text = " ".join(words) if words else ("" if stdin.isatty() else stdin.read())
    text = text.strip(SPACE)
    if not text:
        raise ValueError("content is empty")
    return text


def tags_of(text: str) -> list[str]:
    return [t for t in (x.strip(SPACE) for x in text.split(",")) if t]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest")
    top.add_argument("--db")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, **flags) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for o in options:
            p.add_argument(o, nargs="*" if o == "words" else None)
        for o, default in flags.items():
            if isinstance(default, bool):
                p.add_argument(f"--{o.replace('_', '-')}", action="store_true")
            else:
                p.add_argument(f"--{o.replace('_', '-')}", default=default, type=type(default))
        return p

    command("put", "ns", "key", "words", kind="", tags="", priority="", meta="", ttl="")
    command("get", "ns", "key", version=0, history=False)
    command("list", ns="", kind="", tags="", limit=20, keys_only=False)
    command("search", "words", ns="", kind="", limit=20)
    command("context", "words", ns="", kind="", tags="", budget=4000)
    command("link", "from_ns", "from_key", "to_ns", "to_key", rel="relates_to", remove=False)
    command("ns")
    command("stats")
    command("rm", "ns", "key", hard=False, all_versions=False)
    command("export", ns="")
    command("import", "path")
    return top


def _rows(rows: DataFrame) -> list[dict]:
    return [json.loads(r["value"]) for r in rows.select(json_row().alias("value")).collect()]


def _plain(row: Row) -> dict:
    return {k: v for k, v in json.loads(json.dumps(row.asDict(True), default=str)).items() if v is not None}


def run(store: Store, args: argparse.Namespace, out=sys.stdout, stdin=sys.stdin) -> None:
    show = lambda x, indent=2: print(json.dumps(x, indent=indent, ensure_ascii=False), file=out)
    match args.command:
        case "put":
            row = store.put(args.ns, args.key, content_of(args.words, stdin), args.kind, tags_of(args.tags), args.priority, args.meta or None, args.ttl)
            show(_plain(row), None)
        case "get":
            rows = [_plain(r) for r in store.get(args.ns, args.key, args.version, args.history)]
            show(rows if args.history else rows[0])
        case "list":
            rows = store.list(args.ns, args.kind, tags_of(args.tags), args.limit)
            if args.keys_only:
                for r in rows.select("ns", "key").collect():
                    print(f"{r['ns']}/{r['key']}", file=out)
            else:
                show(_rows(rows) or None)
        case "search":
            show(_rows(store.search(" ".join(args.words), args.ns, args.kind, args.limit).orderBy("place")))
        case "context":
            show(store.context(" ".join(args.words), args.ns, args.kind, tags_of(args.tags), args.budget).first().asDict(True))
        case "link":
            show(_plain(store.link((args.from_ns, args.from_key), (args.to_ns, args.to_key), args.rel, args.remove)))
        case "ns":
            show([_plain(r) for r in store.namespaces().collect()] or None)
        case "stats":
            show(_plain(store.stats().first()) | {"namespaces": [_plain(r) for r in store.namespaces().collect()]})
        case "rm":
            store.rm(args.ns, args.key, args.hard, args.all_versions)
            show({"status": "deleted", "ns": args.ns, "key": args.key})
        case "export":
            json_io.write_array(store.export(args.ns), out)
        case "import":
            show({"imported": store.import_json(args.path)})


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = {k: os.environ[f"PALIMPSEST_EMBED_{k.upper()}"] for k in ("provider", "url", "model", "key", "dims") if f"PALIMPSEST_EMBED_{k.upper()}" in os.environ}
    try:
        run(Store(spark, store_path(args.db), from_config(config)), args)
    except (LookupError, ValueError, RuntimeError) as e:
        print(f"error: {args.command}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
