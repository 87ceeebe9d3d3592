"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes is reduced to additive totals and written as one folder named after the batch.
Committing a batch that is already there does nothing, and a batch whose writer died is written
again, so every batch counts once. Totals are the sum over committed batches; ``compact`` folds
batches into one, remembering their names. Nothing is read back per document, so the cost of a batch
follows its changes alone.

Changes: ``insert`` adds a document and its tokens, ``delete`` takes them out, ``revise`` replaces
``old_tokens`` by ``tokens``. Defined results. Null tokens are 0; null source, language or version is
a group of its own; an unknown operation raises; repeated rows count each time; groups that reach no
documents and no tokens are left out; an empty batch is committed and changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
TOTALS = "source string, lang string, version string, documents bigint, tokens bigint"


def signed(changes: DataFrame) -> DataFrame:
    """Additive totals of (source, lang, version, operation, tokens, old_tokens)."""
    kind = F.col("operation")
    many = F.coalesce("tokens", F.lit(0))
    one = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(kind, F.lit("null")))))
    tokens = F.when(kind == "insert", many).when(kind == "delete", -many).otherwise(many - F.coalesce("old_tokens", F.lit(0)))
    return changes.groupBy(*KEYS).agg(F.sum(one).cast("bigint").alias("documents"), F.sum(tokens).cast("bigint").alias("tokens"))


class Rollup:
    """Committed batches below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _there(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Write the batch's totals; False if it was committed before."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError("a batch name has letters, digits and hyphens")
        path = f"{self.folder}/batches/{batch}"
        if batch in self.batches():
            return False
        signed(changes).write.mode("overwrite").parquet(path)  # whole when its _SUCCESS is there
        return True

    def _listed(self, kind: str) -> list[str]:
        fs, p = self._fs(f"{self.folder}/{kind}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if self._there(f"{self.folder}/{kind}/{n}/_SUCCESS"))

    def _folded(self) -> tuple[str | None, set[str]]:
        bases = self._listed("bases")
        if not bases:
            return None, set()
        names = self.spark.read.text(f"{self.folder}/names/{bases[-1]}").collect()  # one name per batch
        return f"{self.folder}/bases/{bases[-1]}", {r[0] for r in names}

    def batches(self) -> set[str]:
        return set(self._listed("batches")) | self._folded()[1]

    def totals(self) -> DataFrame:
        base, folded = self._folded()
        paths = [f"{self.folder}/batches/{b}" for b in self._listed("batches") if b not in folded] + ([base] if base else [])
        rows = self.spark.read.schema(TOTALS).parquet(*paths) if paths else self.spark.createDataFrame([], TOTALS)
        summed = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return summed.filter("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new base; the names are written first, the base commits it."""
        names, number = sorted(self.batches()), len(self._listed("bases"))
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/names/{number:08d}")
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/bases/{number:08d}")


def space_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def letter_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint")
