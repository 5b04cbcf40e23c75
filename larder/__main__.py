"""Command line: one sentence gives one record as JSON, several give a list."""

from __future__ import annotations

import json
import sys

USAGE = "usage: python -m larder SENTENCE [SENTENCE ...]"


def main(arguments: list[str]) -> int:
    if not arguments:
        print(USAGE, file=sys.stderr)
        return 1
    if arguments[0] in ("-h", "--help"):
        print(USAGE)
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.parse import parse_many

    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    rows = parse_many(spark, arguments).orderBy("sentence_id").select(F.to_json("parsed", {"ignoreNullFields": "false"}).alias("j")).collect()
    found = [json.loads(r.j) for r in rows]
    print(json.dumps(found[0] if len(found) == 1 else found, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
