"""python -m codexmill --path FOLDER COMMAND ...: single queries over a corpus, as JSON."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codexmill", description="Queries over a corpus of Parquet tables.")
    p.add_argument("--path", required=True, help="folder of the tables")
    p.add_argument("--suffix", default="", help="suffix of the table names, such as .parquet")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("status")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--limit", type=int, default=20)
    s.add_argument("--language")
    s.add_argument("--corpus")
    s.add_argument("--context", type=int, default=0)
    for name in ("context", "evidence", "provenance"):
        c = sub.add_parser(name)
        c.add_argument("--record-id", type=int, required=True)
        if name != "provenance":
            c.add_argument("--window", type=int, default=2)
    for name in ("work", "parallels", "resolve", "variants"):
        c = sub.add_parser(name)
        c.add_argument("identifier")
        if name == "resolve":
            c.add_argument("--limit", type=int, default=100)
    sub.add_parser("compare").add_argument("identifiers", nargs="+")
    e = sub.add_parser("export")
    e.add_argument("--output", required=True)
    e.add_argument("--max-shard-bytes", type=int, default=512 * 1024)
    m = sub.add_parser("pointers")
    m.add_argument("--output", required=True)
    m.add_argument("--limit", type=int, default=20)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from codexmill.corpus import Corpus
    from codexmill.session import build_session

    spark = build_session(a.master)
    spark.sparkContext.setLogLevel("ERROR")
    c = Corpus(spark, a.path, a.suffix)
    run = {
        "status": lambda: c.status(),
        "search": lambda: c.search(a.query, a.limit, a.language, a.corpus, a.context),
        "context": lambda: c.context(a.record_id, a.window),
        "evidence": lambda: c.evidence(a.record_id, a.window),
        "provenance": lambda: c.provenance(a.record_id),
        "work": lambda: c.work(a.identifier),
        "parallels": lambda: c.parallels(a.identifier),
        "resolve": lambda: c.resolve(a.identifier, a.limit),
        "variants": lambda: c.variants_of(a.identifier),
        "compare": lambda: c.compare(a.identifiers),
        "export": lambda: c.export(a.output, a.max_shard_bytes),
        "pointers": lambda: {"new_keys": c.materialize(a.output, a.limit)},
    }
    try:
        print(json.dumps(run[a.command](), ensure_ascii=False, indent=2))
    except ValueError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
