"""Model files: gzip JSON weights for the tagger and the chain, GloVe text vectors, food tables."""

from __future__ import annotations

import gzip
import json
import uuid
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chain import Chain, default_chain
from ..functions.tagger import PerceptronTagger, RuleTagger


@cache
def read_gzip_json(path: str):
    """A gzip JSON file, read once in a process."""
    with gzip.open(path, "rt", encoding="utf-8") as f:
        return json.load(f)


FILES = {"chain": "model.en.json.gz", "tagger": "averaged_perceptron_tagger_eng.json.gz", "tagdict": "ingredient_tagdict.json.gz"}
MOST_BYTES = 256 << 20


@dataclass(frozen=True)
class Models:
    """Where weights are: paths that every worker can open, or files that were read on the driver and broadcast; without any the rule
    tagger and the hand-set chain are used.

    Workers unpack what they need once and keep it: a plan holds paths or a broadcast, not weights.
    """

    chain_path: str | None = None
    tagger_path: str | None = None
    tagdict_path: str | None = None
    sent: Broadcast | None = None
    key: str = ""

    @classmethod
    def from_directory(cls, folder: str) -> Models:
        """Files of a local folder by their usual names, each optional."""
        return cls(**{f"{k}_path": str(p) for k, n in FILES.items() if (p := Path(folder) / n).exists()})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Models:
        """Files by their usual names, each optional, of a folder that Spark can read, on whatever filesystem.  They are broadcast as
        they are, ``MOST_BYTES`` together at most."""
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(folder).where(F.element_at(F.split("path", "/"), -1).isin(*FILES.values()))
        if (found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) > MOST_BYTES:
            raise ValueError(f"model files are broadcast: {MOST_BYTES} bytes at most")
        files = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in found.collect()}
        return cls(sent=spark.sparkContext.broadcast({k: files[n] for k, n in FILES.items() if n in files}), key=uuid.uuid4().hex)

    def _read(self, kind: str, path: str | None):
        if self.sent is None:
            if path and not path.endswith(".json.gz"):
                raise ValueError(f"weights are in a .json.gz file, not in {path}")
            return read_gzip_json(path) if path else None
        return json.loads(gzip.decompress(self.sent.value[kind])) if kind in self.sent.value else None

    def _kept(self, kind: str, path: str | None, make):
        name = (kind, path, self.key)
        if name not in _made:
            _made[name] = make(self._read(kind, path))
        return _made[name]

    def chain(self) -> Chain:
        return self._kept("chain", self.chain_path, lambda x: Chain.from_json(x) if x else default_chain())

    def tagger(self):
        return self._kept("tagger", self.tagger_path, lambda x: PerceptronTagger(x["weights"], x["tagdict"], x["classes"]) if x else RuleTagger())

    def tagdict(self) -> dict[str, str]:
        return self._kept("tagdict", self.tagdict_path, lambda x: x or {})


_made: dict[tuple, object] = {}


def read_glove(spark: SparkSession, path: str) -> DataFrame:
    """(token, vec) of a GloVe text file, gzip or not: a header ``n dim``, then a token and its numbers in each row."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") > 2)
    return parts.select(F.col("p")[0].alias("token"), F.transform(F.slice("p", 2, F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def read_foods(spark: SparkSession, path: str) -> DataFrame:
    """(fdc_id, data_type, description, category) of a CSV file with a header, quoted as RFC 4180 says."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    return rows.select(F.col("fdc_id").cast("int"), "data_type", "description", "category").where("fdc_id is not null")
