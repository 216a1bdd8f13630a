"""What the operators of this package share: reading inputs, cutting lineage, batching texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose few files can't be split among all cores (one row group each, say) is dealt out anew; any other is
    read as it is. How many splits its scan has is known from planning alone; only where they are few is it counted which
    of them have rows (from the files' footers)."""
    df, cores = read_table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    if splits > 4 * cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(2 * cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset and driver and executors are one
    process, a temporary one; on a cluster that would lose rows, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written since the last ``release``.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: computed once, and its lineage is cut,
    so that a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that ``written`` has made so far. For callers that have stored whatever was made of them: results
    are lazy and read these tables until then."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def chunks(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum up to ``limit`` or a little more."""
    begin = end = total = 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield begin, end
            begin, total = end, 0
    if end > begin:
        yield begin, end


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
