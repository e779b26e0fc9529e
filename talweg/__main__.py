"""Run queries and analytics over a directory of tables.

    python -m talweg QUERY TABLES OUT                     one registered query to Parquet
    python -m talweg analytics TABLES OUT [--metric M] [--snapshot-id S] [--publish]
                                                          a metric's queries (or all) as one JSON snapshot
    python -m talweg release TABLES OUT --snapshot-id S [--publish]
                                                          all items of a serving release, its manifest and (published) the pointer
"""

import argparse
import sys


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    from talweg.operators import runs
    from talweg.plans import registry

    queries = registry.queries()
    parser = argparse.ArgumentParser(prog="python -m talweg", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter, epilog="Queries: " + ", ".join(sorted(queries)))
    parser.add_argument("what", choices=["analytics", "release", *sorted(queries)], metavar="QUERY|analytics|release")
    parser.add_argument("tables")
    parser.add_argument("out")
    parser.add_argument("--metric", default="all", choices=["all", *runs.METRICS])
    parser.add_argument("--snapshot-id")
    parser.add_argument("--publish", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.what == "analytics":
        print(*runs.analytics(spark, a.tables, a.out, a.metric, a.snapshot_id, a.publish), sep="\n")
    elif a.what == "release":
        from talweg.plans import snapshot

        if not a.snapshot_id:
            parser.error("a release needs --snapshot-id")
        print(snapshot.release(spark, a.tables, a.out, a.snapshot_id, candidate=not a.publish).manifest)
    else:
        queries[a.what](spark, a.tables).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
