"""Tables of Parquet folders, dealt into buckets by key, of which a batch rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder_of(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Buckets:
    """A bucket's rows lie in ``bucket=b/v=n``, n being one more than the batch that wrote them; the newest counts.

    A batch reads what stood before it, so one that runs again writes the same. A bucket's versions before the one that
    a batch read are deleted when it has written: of each bucket at most two stay.
    """

    def __init__(self, spark: SparkSession, table: str, keys: list[str], n: int = 64):
        self.spark, self.table, self.keys, self.n = spark, table, keys, n

    def _bucket(self):
        return F.pmod(F.hash(*self.keys), F.lit(self.n))

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of a batch's keys, at most n."""
        return [r[0] for r in batch.select(self._bucket().alias("bucket")).distinct().collect()]

    def versions(self, upto: int | None = None) -> dict[int, int]:
        """The newest version of each bucket, of those that batches before ``upto`` wrote. Folders are listed, not rows."""
        pattern, fs = folder_of(self.spark, f"{self.table}/bucket=*/v=*")
        out: dict[int, int] = {}
        for status in fs.globStatus(pattern) or []:
            b, v = (int(p.getName().split("=")[1]) for p in (status.getPath().getParent(), status.getPath()))
            if upto is None or v <= upto:
                out[b] = max(v, out.get(b, 0))
        return out

    def read(self, schema: StructType, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows as batches before ``upto`` left them, of some buckets or all."""
        found = {b: v for b, v in self.versions(upto).items() if buckets is None or b in buckets}
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.table}/bucket={b}/v={v}" for b, v in sorted(found.items())])

    def write(self, rows: DataFrame, number: int, touched: list[int]) -> None:
        """The new rows of the touched buckets."""
        if not touched:
            return
        before = self.versions(number)
        rows = rows.withColumns({"bucket": self._bucket(), "v": F.lit(number + 1)})
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(self.table)
        for b in touched:
            made, fs = folder_of(self.spark, f"{self.table}/bucket={b}/v={number + 1}")
            fs.mkdirs(made)  # a bucket that is empty now
            where = made.getParent()
            for status in fs.listStatus(where):
                if int(status.getPath().getName().split("=")[1]) < before.get(b, 0):
                    fs.delete(status.getPath(), True)
