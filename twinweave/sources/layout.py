"""A catalogue that lies as it is asked for.

``bucketed`` tables hold rows in files by the hash of their key, sorted by it:
a join on the key moves the other side only. ``Ranges`` holds rows in folders by
ranges of a column: a lookup opens the folders that its range meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """``df`` as a table of ``buckets`` by ``key``, each in files sorted by it; ``path`` puts it in a folder of its own.

    The session's catalogue keeps the layout, so later sessions with the same
    catalogue join it without a shuffle too. An existing table is replaced.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


class Ranges:
    """Rows by ranges of a numeric or time column, in about ``n`` folders of like size; nulls have one of their own.

    The bounds are a small table beside them, of one row a folder.
    """

    def __init__(self, spark: SparkSession, path: str, column: str, schema: T.StructType | str):
        self.spark, self.path, self.column = spark, path.rstrip("/"), column
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def write(self, df: DataFrame, n: int = 64) -> None:
        """Bounds come from approximate quantiles; what is found doesn't depend on them, only how many rows a folder has."""
        known = df.filter(F.col(self.column).isNotNull())
        cuts = known.agg(F.percentile_approx(F.col(self.column), [k / n for k in range(1, n)], 10_000)).first()[0] or []
        cuts = sorted(set(cuts))
        band = F.lit(0)
        for k, cut in enumerate(cuts, 1):
            band = F.when(F.col(self.column) > F.lit(cut), k).otherwise(band)
        placed = df.select(*self.schema.names).withColumn("band", F.when(F.col(self.column).isNull(), -1).otherwise(band))
        # a band of equal values may hold most rows, so rows are dealt by a second key within it
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(4))
        placed.repartition("band", spread).sortWithinPartitions("band", self.column).write.mode("overwrite").partitionBy("band").parquet(f"{self.path}/rows")
        bounds = placed.filter("band >= 0").groupBy("band").agg(F.min(self.column).alias("least"), F.max(self.column).alias("most"))
        bounds.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/bounds")

    def bands(self, low=None, high=None) -> list[int]:
        """Folders that hold values from ``low`` to ``high``: one small number for each reaches the driver."""
        bounds = self.spark.read.parquet(f"{self.path}/bounds")
        for bound, test in ((low, F.col("most") >= F.lit(low)), (high, F.col("least") <= F.lit(high))):
            bounds = bounds if bound is None else bounds.filter(test)
        return sorted(r[0] for r in bounds.select("band").collect())

    def read(self, low=None, high=None) -> DataFrame:
        """Rows whose value is in the closed range, open where None, from the folders that may hold one."""
        if low is None and high is None:
            return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("band", T.IntegerType())])).parquet(f"{self.path}/rows").drop("band")
        bands = self.bands(low, high)
        if not bands:
            return self.spark.createDataFrame([], self.schema)
        # other folders aren't even listed
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/band={b}" for b in bands])
        for bound, test in ((low, F.col(self.column) >= F.lit(low)), (high, F.col(self.column) <= F.lit(high))):
            rows = rows if bound is None else rows.filter(test)
        return rows
