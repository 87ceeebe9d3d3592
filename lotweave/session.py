"""Session helpers: table reading and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query that has ended; else they lie there until the driver collects garbage.
SHUFFLE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans made inside delete their shuffle files when they end; one that should meet such a shuffle again makes it anew."""
    own = spark.conf.get(SHUFFLE_SETTING, None)
    spark.conf.set(SHUFFLE_SETTING, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(SHUFFLE_SETTING)
        else:
            spark.conf.set(SHUFFLE_SETTING, own)


def _checkpoint_dir_ready(spark: SparkSession) -> None:
    """Use the folder the cluster names; name one only on a local master that has none."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lotweave-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables; it raises where a cluster names none."""
    _checkpoint_dir_ready(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back as a plan leaf; the shuffles that made it go."""
    _checkpoint_dir_ready(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


#: Rows of a file of a ``stored`` table: small files let its readers share them out evenly.
FILE_ROWS = 50_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as compressed columns in the shared folder, for large tables that are read row by row: joins would guess them too small."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lotweave-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(table: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
