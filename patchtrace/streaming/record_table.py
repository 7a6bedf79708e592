"""A keyed record table that batches update in place, by bucket and version (F13 as a stream).

The reference replaces a file's record as soon as a later one arrives. Here a table of
latest records is cut into hash buckets of the key. A batch

1. is reduced to its latest record for each key (a partial aggregate, so a hot key costs one row a task);
2. rewrites only the buckets that it touches: their current records and the batch's, the
   latest of each key, as new files below the batch's version;
3. is committed by one appended log row that names its version and buckets.

A bucket's current files are those of the last committed version that names it, so readers
see a batch wholly or not at all, and a batch that died before its log row leaves files that
nobody reads. A committed batch that is replayed is skipped. Late records lose against what is
there (by ``seq``, then by the record itself, as in ``spans.latest_per_key``). One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchtrace.operators.spans import latest_per_key

LOG = "version long, batch long, buckets array<int>"


class RecordTable:
    """The latest record of each key, below ``path``. ``schema`` (DDL) holds ``key`` and ``seq``.

    ``n_buckets`` is fixed for a table's life: a batch rewrites at most 1 / n_buckets of it for each
    key, and a bucket is one file. Null keys are a key like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "file_path", seq: str = "seq",
                 n_buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.seq, self.n_buckets = key, seq, n_buckets
        self.columns = spark.createDataFrame([], schema).columns
        spark.createDataFrame([], LOG).write.mode("append").parquet(f"{self.path}/log")

    def log(self) -> list:
        """One row for each committed batch."""
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy("version").collect()

    def _folder(self, version: int) -> str:
        return f"{self.path}/records/version={version}"

    def _current(self, log: list, buckets: set[int] | None = None) -> list[str]:
        """Folders of the current files of these buckets (of all, if None)."""
        version = {b: r["version"] for r in log for b in r["buckets"]}
        return [f"{self._folder(v)}/bucket={b}" for b, v in sorted(version.items()) if buckets is None or b in buckets]

    def _records(self, folders: list[str]) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else empty

    def read(self) -> DataFrame:
        """The table as of the last committed batch."""
        return self._records(self._current(self.log()))

    def upsert(self, records: DataFrame, batch: int) -> None:
        """Take in a batch of records."""
        log = self.log()
        if any(r["batch"] == batch for r in log):
            return
        version = len(log)
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.n_buckets)).cast("int")
        new = latest_per_key(records.select(*self.columns), self.key, self.seq).withColumn("bucket", bucket).checkpoint()
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most n_buckets
        held = self._records(self._current(log, set(touched)))
        both = held.select(*self.columns).unionByName(new.select(*self.columns))
        if touched:
            (latest_per_key(both, self.key, self.seq).withColumn("bucket", bucket).repartition("bucket")
             .write.mode("overwrite").partitionBy("bucket").parquet(self._folder(version)))
        self._commit(version, batch, touched)

    def _commit(self, version: int, batch: int, buckets: list[int]) -> None:
        row = self.spark.createDataFrame([(version, batch, buckets)], LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")


def upsert_arrivals(spark: SparkSession, landing: str, schema: str, checkpoint: str, table: RecordTable,
                    max_files_per_trigger: int | None = None) -> None:
    """F13 + I2: every file that arrived in ``landing`` updates ``table`` once; returns when all are done."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.load(landing).writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
