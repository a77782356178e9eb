"""``python -m cairnway PATH [--out FOLDER]``: index a tree, write its tables, the map and the progress, print a line for each layer."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from cairnway.config import read_options
from cairnway.operators import order, reports
from cairnway.operators.lifecycle import Progress, begun_or_refreshed, exports_of
from cairnway.operators.progress import hash_diff, utc_now
from cairnway.plans.index import entries, index
from cairnway.plans.staging import clear, held, staged
from cairnway.sources import git
from cairnway.sources.documents import hashes_or_none, map_document, map_hash, progress_document, progress_or_none, read_map, write_document, write_table


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairnway", description="Index a source tree into tables.")
    parser.add_argument("path", nargs="?", default=".")
    parser.add_argument("--out", help="folder of the tables (default: PATH/.cairnway)")
    parser.add_argument("--verbose", action="store_true", help="also print how many files each pass holds")
    args = parser.parse_args(argv)
    root = Path(args.path).resolve()
    if not root.is_dir():
        print(f"{root} is not a directory", file=sys.stderr)
        return 1
    out = Path(args.out) if args.out else root / ".cairnway"
    spark = SparkSession.builder.appName("cairnway").getOrCreate()
    since = held(spark)
    known = staged(hashes_or_none(spark, str(out / "map.json")), "known")
    before = progress_or_none(spark, str(out / "progress.json"))
    if before is not None:
        before = Progress(staged(before.meta, "progress-meta"), staged(before.files, "progress-files"), staged(exports_of(before), "progress-exports"))
    found = index(spark, str(root), read_options(out))
    for table, rows in found.tables.items():
        write_table(rows, str(out / table))
    listed = staged(entries(found), "entries")
    write_table(listed, str(out / "entries"))
    write_document(map_document(listed, found.files, str(root), utc_now()), str(out / "map.json"))
    name = map_hash(read_map(spark, str(out / "map.json"))).first()["hash"]  # one row
    changes = hash_diff(known, found.files.select("path", "hash"))
    progress = begun_or_refreshed(before, listed, name, changes, found.edges, git.head(str(root)), git.branch(str(root)))
    write_document(progress_document(progress), str(out / "progress.json"))
    placed = found.order.select("path", "layer")
    for row in sorted(reports.index_summary(placed).collect(), key=lambda r: order.LAYERS.index(r.layer)):  # five rows at most
        print(row.line)
    if args.verbose:
        for row in found.order.groupBy("pass").count().collect():  # three rows at most
            print(f"{row['pass']}: {row['count']}")
    clear(spark, since)
    return 0


if __name__ == "__main__":
    sys.exit(main())
