"""Command line: python -m excerpta.cli ROOT VERB ..."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from excerpta.errors import EvidenceError
from excerpta.functions import vectors as vec
from excerpta.operators.members import difference_counts
from excerpta.registry import LibraryRegistry
from excerpta.session import local_session
from excerpta.tools import EvidenceTools, call_tool
from excerpta.vector_store import VectorStore


def parser():
    main = argparse.ArgumentParser(prog="excerpta")
    main.add_argument("root", help="application folder on any Hadoop file system")
    verbs = main.add_subparsers(dest="verb", required=True)
    verbs.add_parser("libraries")
    create = verbs.add_parser("create")
    create.add_argument("name")
    create.add_argument("--description", default="")
    for name in ("snapshots", "build", "verify", "search", "diff", "activate", "build-vectors", "verify-vectors"):
        verb = verbs.add_parser(name)
        verb.add_argument("library_id")
        if name == "build":
            verb.add_argument("sources", nargs="*")
            verb.add_argument("--base")
            verb.add_argument("--remove", action="append", default=[], metavar="DOCUMENT_ID")
            verb.add_argument("--replace", action="append", default=[], metavar="DOCUMENT_ID=FILE")
        elif name != "snapshots":
            verb.add_argument("snapshot_id")
        if name.endswith("-vectors"):
            verb.add_argument("--profile", required=True, help="JSON file of the embedding profile")
        if name == "build-vectors":
            verb.add_argument("--embedder", required=True, metavar="MODULE:CLASS")
        if name == "search":
            verb.add_argument("query")
            verb.add_argument("--top-k", type=int, default=5)
            verb.add_argument("--excerpt-chars", type=int, default=1000)
    tool = verbs.add_parser("tool", help="call a read-only tool with JSON arguments")
    tool.add_argument("name")
    tool.add_argument("arguments", nargs="?", default="{}")
    return main


def run(spark, args):
    registry = LibraryRegistry(spark, args.root)
    if args.verb == "libraries":
        return registry.overview()
    if args.verb == "create":
        return registry.create(args.name, args.description)
    if args.verb == "tool":
        return call_tool(EvidenceTools(registry), args.name, json.loads(args.arguments))
    library = registry.library(args.library_id)
    if args.verb == "snapshots":
        return library.list_snapshots()
    if args.verb == "build":
        replacements = dict(item.split("=", 1) for item in args.replace)
        return library.build(
            args.sources, base_snapshot_id=args.base, replacements=replacements, remove_document_ids=args.remove
        )
    if args.verb == "verify":
        return library.verify(args.snapshot_id)
    if args.verb == "activate":
        return library.activate(args.snapshot_id)
    if args.verb == "diff":
        return difference_counts(library.difference(args.snapshot_id)).first().asDict()
    if args.verb == "search":
        return EvidenceTools(registry).search_documents(
            args.library_id, args.snapshot_id, args.query, top_k=args.top_k, excerpt_chars=args.excerpt_chars
        )
    with open(args.profile, encoding="utf-8") as file:
        profile = json.load(file)
    store = VectorStore(library)
    if args.verb == "build-vectors":
        module, _, name = args.embedder.partition(":")
        return store.build(args.snapshot_id, profile, getattr(importlib.import_module(module), name)())
    return store.verify(args.snapshot_id, vec.profile_id(profile))


def main(argv=None):
    args = parser().parse_args(argv)
    try:
        result = run(local_session("excerpta-cli"), args)
    except EvidenceError as error:
        print(json.dumps({"error": str(error)}, ensure_ascii=False), file=sys.stderr)
        return 2
    print(json.dumps(result, ensure_ascii=False, sort_keys=True, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
