"""Command line: build a graph from files, look things up in one."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame

from docloom.operators.store import Store, search_names, type_counts
from docloom.plans.knowledge import build, save
from docloom.session import session
from docloom.sources.documents import load_status, read_files


def found(entities: DataFrame, name: str) -> list[dict[str, object]]:
    return [r.asDict() for r in search_names(entities, name).select("id", "name", "type", "score").toLocalIterator()]


def types(entities: DataFrame) -> dict[str, int]:
    return {r["type"]: r["n"] for r in type_counts(entities).toLocalIterator()}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="docloom", description=__doc__)
    p.add_argument("input", nargs="?", help="a file or a folder of documents")
    p.add_argument("--store", required=True, help="folder of the store")
    p.add_argument("--pattern", default="*", help="names of the files to read")
    p.add_argument("--domains", nargs="+", default=["simple"])
    p.add_argument("--search", help="look a name up")
    p.add_argument("--stats", action="store_true", help="count entities by type")
    p.add_argument("--json", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--verbose", action="store_true", help="also list the files that were refused, with their reasons")
    p.add_argument("--batch", action="store_true", help="the input must be a folder")
    p.add_argument("--interactive", action="store_true", help="read commands: stats, search NAME, quit")
    a = p.parse_args(argv)
    if not (a.input or a.search or a.stats or a.interactive):
        p.error("nothing to do: give an input, --search, --stats or --interactive")
    if a.batch and not (a.input and not os.path.isfile(a.input)):
        p.error("--batch needs a folder as input")
    spark = session()
    out: dict[str, object] = {}
    store = Store(spark, a.store)
    if a.input:
        docs, errors = read_files(spark, a.input, a.pattern)
        graph = build(spark, docs.selectExpr("source_file AS doc_id", "content AS text"), f"{a.store}/work", a.domains)
        store = save(spark, graph, a.store)
        out["files"] = {r["status"]: r["count"] for r in load_status(docs, errors).toLocalIterator()}
        out["status"] = graph.status().first().asDict()
        if a.verbose:
            out["refused"] = {r["source_file"]: r["error"] for r in errors.select("source_file", "error").toLocalIterator()}
    entities = store.load("entities")
    if a.search and entities is not None:
        out["found"] = found(entities, a.search)
    if a.stats and entities is not None:
        out["types"] = types(entities)
    if a.interactive:
        for line in sys.stdin:
            word, _, rest = line.strip().partition(" ")
            if word == "quit":
                break
            if word == "stats" and entities is not None:
                print(json.dumps(types(entities), ensure_ascii=False))
            elif word == "search" and entities is not None:
                print(json.dumps(found(entities, rest), ensure_ascii=False, default=str))
            else:
                print("stats, search NAME or quit" if entities is not None else "the store is empty")
    if not a.quiet:
        print(json.dumps(out, ensure_ascii=False, default=str) if a.json else "\n".join(f"{k}: {v}" for k, v in out.items()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
