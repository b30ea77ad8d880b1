"""Helpers shared by the operators of this package: Arrow functions over texts, shared storage, byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from timedframe.operators.ordered import shared_folder

#: UTF-8 bytes of text that a Python step works on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: How folders of copies are named.
COPY = "timedframe-copy-"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to the cluster's checkpoint folder and read back, so that several readers and lost executors don't recompute.

    ``discard`` deletes the copy; what is left goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{COPY}{uuid.uuid4().hex}"
    # The copy is complete, so the shuffle files that led to it can go at once.
    was = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)
    place, files = _file_system(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(*copies: DataFrame | None) -> None:
    """Deletes copies that no later step reads."""
    for df in copies:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()} if df is not None else ():
            if path.rpartition("/")[2].startswith(COPY):
                place, files = _file_system(df.sparkSession, path)
                files.delete(place, True)


def slices(lengths: Sequence[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges of at most ``limit`` bytes, or of one row."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if len(lengths) > start:
        yield start, len(lengths)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """The texts in slices balanced by bytes, null as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lengths = pc.binary_length(texts).to_pylist()
    for a, b in slices(lengths, limit):
        yield texts.slice(a, b - a).to_pylist()


def text_function(work: Callable[[], Callable[[list[str]], Sequence[Iterable]]], returns: str) -> Callable[[Column], Column]:
    """A column function over texts that returns a struct.

    ``work()`` is called once per task and gives a function from a list of texts (null read as empty) to
    one sequence per field.  Rows come in Arrow batches, which are cut to slices of bounded bytes.
    """
    kind = StructType.fromDDL(returns)
    fields = list(to_arrow_schema(kind))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = work()
        for batch in batches:
            columns: list[list[pa.Array]] = [[] for _ in fields]
            for texts in text_slices(batch):
                for held, values, field in zip(columns, apply(texts), fields, strict=True):
                    held.append(pa.array(values, type=field.type))
            arrays = [pa.concat_arrays(c) if c else pa.array([], type=f.type) for c, f in zip(columns, fields, strict=True)]
            yield pa.StructArray.from_arrays(arrays, fields=[pa.field(f.name, f.type) for f in fields])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returnType=kind)


def joined_bytes(texts: list[str], fold: bool = False, gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by ``gap``, and the start of each plus the end."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    if fold:
        raw = [r.lower() for r in raw]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + len(gap) for r in raw], out=starts[1:])
    return np.frombuffer(gap.join([*raw, b""]), np.uint8), starts


def held_out(column: str, parts: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; a null id counts as empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % parts) == remainder


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
