"""Connections by URL: Parquet directories, and databases through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import UnsupportedFeature

#: JDBC driver classes by URL scheme; their jars must be on the class path.
JDBC_DRIVERS = {"postgresql": "org.postgresql.Driver", "postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlite": "org.sqlite.JDBC", "turso": "org.sqlite.JDBC"}
FILE_SCHEMES = ("", "file", "hdfs", "s3a", "gs", "abfss", "viewfs", "parquet")


def loader(spark: SparkSession, url: str) -> Callable[[str], DataFrame]:
    """A function from table name to DataFrame. ``parquet:/dir`` and plain or Hadoop paths: ``dir/table.parquet``."""
    scheme = urlsplit(url).scheme
    if scheme in FILE_SCHEMES:
        base = url.removeprefix("parquet://").removeprefix("parquet:").rstrip("/")
        return lambda table: spark.read.parquet(f"{base}/{table}.parquet")
    if scheme in JDBC_DRIVERS:
        driver = JDBC_DRIVERS[scheme]
        try:
            spark.sparkContext._jvm.java.lang.Class.forName(driver)
        except Exception as e:
            raise UnsupportedFeature(f"{scheme}: {driver} is not on the class path") from e
        target = "sqlite:" + url.split("://", 1)[1] if scheme in ("sqlite", "turso") else url.replace("postgres://", "postgresql://")
        return lambda table: spark.read.format("jdbc").option("url", f"jdbc:{target}").option("driver", driver).option("dbtable", table).load()
    if scheme == "dynamodb":
        raise UnsupportedFeature("dynamodb has no Spark source here; export its tables to Parquet")
    raise UnsupportedFeature(f"unknown scheme {scheme!r}")


def finder(spark: SparkSession, url: str) -> Callable[[str], bool]:
    """A function that tells whether there is a table of the name. A folder or file that can't be read is there."""
    scheme = urlsplit(url).scheme
    jvm = spark.sparkContext._jvm
    if scheme in FILE_SCHEMES:
        base = url.removeprefix("parquet://").removeprefix("parquet:").rstrip("/")

        def stored(table: str) -> bool:
            path = jvm.org.apache.hadoop.fs.Path(f"{base}/{table}.parquet")
            return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

        return stored

    def listed(table: str) -> bool:
        target = "sqlite:" + url.split("://", 1)[1] if scheme in ("sqlite", "turso") else url.replace("postgres://", "postgresql://")
        connection = jvm.java.sql.DriverManager.getConnection(f"jdbc:{target}")
        try:
            return connection.getMetaData().getTables(None, None, table, None).next()
        finally:
            connection.close()

    return listed
