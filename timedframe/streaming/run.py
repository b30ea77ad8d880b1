"""Running a stream over what its source holds now, into a table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timedframe.operators.ordered import shared_folder


def read_stream(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of what is there; zone-less timestamps read as UTC instants."""
    reader = spark.readStream.schema(spark.read.option("pathGlobFilter", names).parquet(folder).schema).option("pathGlobFilter", names)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(folder)
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Stateful processors need the state store on disk; a query keeps the one that it was started with."""
    was = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, was)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available and return the written table; state, offsets and output lie in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with rocks_state(spark):
        query = (
            stream.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/state")
            .outputMode("append").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


class Merged:
    """A table that holds the last row of each key of a stream in update mode.

    Every trigger writes the rows that it changed to a folder of its own, named by its epoch; a trigger that is repeated after a
    failure overwrites that folder with the same rows, so nothing counts twice.  Every ``compact`` epochs the merged rows are written
    out whole, and readers start from there.  A restarted stream goes on from its checkpoint, and epochs go on counting.
    """

    def __init__(self, stream: DataFrame, keys: Sequence[str], base: str, compact: int = 50):
        self.stream, self.keys, self.base, self.every = stream, list(keys), base.rstrip("/"), compact
        self.spark = stream.sparkSession
        self.schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, epoch bigint"

    def write(self, batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{self.base}/changes/{epoch:012d}")
        if (epoch + 1) % self.every == 0:
            self._merged(epoch).write.mode("overwrite").parquet(f"{self.base}/whole/{epoch:012d}")

    def drain(self) -> DataFrame:
        """Processes everything available and returns the table."""
        with rocks_state(self.spark):
            query = (
                self.stream.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.base}/state")
                .outputMode("update").trigger(availableNow=True).start()
            )
        query.awaitTermination()
        return self.read()

    def read(self) -> DataFrame:
        """The last row of each key."""
        return self._merged(None).drop("epoch")

    def _epochs(self, part: str) -> list[int]:
        """Epochs whose folder is complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{part}/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName()) for f in found or [])

    def _merged(self, upto: int | None) -> DataFrame:
        whole = [e for e in self._epochs("whole") if upto is None or e < upto][-1:]
        changes = [e for e in self._epochs("changes") if (upto is None or e <= upto) and (not whole or e > whole[0])]
        paths = [*(f"{self.base}/whole/{e:012d}" for e in whole), *(f"{self.base}/changes/{e:012d}" for e in changes)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        rest = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r"))
        return last.select(*[F.col(c) if c in self.keys else F.col("r")[c].alias(c) for c in rows.columns])


def drain_merged(stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """Processes everything available in update mode and returns the last row of each key."""
    return Merged(stream, keys, f"{shared_folder(stream.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}").drain()
