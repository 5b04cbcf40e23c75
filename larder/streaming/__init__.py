"""Parsing as a stream: every record depends on its own sentence, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.amounts import Options
from ..plans.parse import parse
from ..sources.models import Models


def parse_stream(spark: SparkSession, path: str, options: Options | None = None, models: Models | None = None) -> DataFrame:
    """A streaming DataFrame (sentence, parsed) of the text files that arrive in a folder, a sentence in each line.

    Food matching joins distinct names, which an append stream can't; parse without it and match in ``foreachBatch``.
    """
    if options and options.foundation_foods:
        raise ValueError("food matching needs a batch: call match_foods in foreachBatch")
    lines = spark.readStream.text(path).withColumnRenamed("value", "sentence")
    return parse(lines, options=options, models=models)
