"""Command line: python -m noemata {init,ingest,search,verify,stats} FOLDER ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text
from .schema import Vocabulary
from .sources import code, files
from .store import KnowledgeBase


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("noemata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _open(spark: SparkSession, folder: str) -> KnowledgeBase:
    schema = Path(folder, "vocabulary.json")
    if not schema.exists():
        sys.exit(f"{folder} holds no knowledge base; make one with: python -m noemata init {folder} VOCABULARY.json")
    return KnowledgeBase(spark, f"{folder}/tables", Vocabulary.load(str(schema)))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="noemata")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in (("init", ["vocabulary"]), ("ingest", ["root"]), ("search", ["text"]), ("verify", ["text"]), ("stats", [])):
        sub = commands.add_parser(name)
        for argument in ["folder", *extra]:
            sub.add_argument(argument)
        if name == "search":
            sub.add_argument("--persona")
            sub.add_argument("--limit", type=int, default=10)
        if name == "ingest":
            sub.add_argument("--since", help="only files modified later")
    a = parser.parse_args(argv)
    if a.command == "init":
        Path(a.folder).mkdir(parents=True, exist_ok=True)
        Vocabulary.load(a.vocabulary).save(str(Path(a.folder, "vocabulary.json")))
        return
    spark = _session()
    kb = _open(spark, a.folder)
    if a.command == "ingest":
        if kb.vocabulary.language == "code":
            rows = code.as_observations(code.code_facts(files.source_files(spark, a.root, since=a.since)), F.current_timestamp())
            with kb:
                kb.upsert(rows)
                kb.consolidate()
        else:
            found = files.text_files(spark, a.root)
            with kb:
                kb.ingest(found.select(F.col("path").alias("doc_id"), "text", F.current_timestamp().alias("timestamp")), consolidate_now=True)
        kb.stats().show(truncate=False)
    elif a.command == "search":
        hits = kb.retrieve(a.text, a.limit, a.persona)
        hits.select(*[text.shortened(F.col(c)).alias(c) for c in ("subject", "predicate", "object")], "polarity", F.round("score", 4).alias("score")).show(a.limit, truncate=False)
    elif a.command == "verify":
        kb.verify_claim(a.text).show(truncate=False)
    else:
        kb.stats().show(truncate=False)
        kb.top_anchors().show(truncate=False)


if __name__ == "__main__":
    main()
