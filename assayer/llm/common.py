"""What the operators share: table readers, shared storage, row keys and text helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import dropped, shared_root, stored  # noqa: F401

#: Non-ASCII characters of these general categories are left as they are by ascii_lower; every
#: character whose lower case differs is among them.
_CASED = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}&&[^\x00-\x7F]]"
#: Bytes of an Arrow batch, and the setting for it.
BATCH_BYTES, _BATCH = 12 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is columns and filters over one scan of Parquet files, so that each of its rows is one
    row of a file and every scan gives the same ones."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return False
    return True


def scannable(df: DataFrame) -> DataFrame:
    """df itself if it is a plain scan of Parquet files, else a stored copy."""
    return df if _plain_scan(df) else stored(df, "rows")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_key(df: DataFrame, name: str = "rid") -> DataFrame:
    """A key for each row; doc_id may be null or repeat. It is the row's number in its file, combined
    with a hash of the file's name: the same for every scan, however the files are split then, and
    equal for two rows with a probability of about files**2 * rows a file / 2**64 in all. A frame that
    isn't a plain scan is stored first; to key one frame twice, make it scannable() before."""
    df = scannable(df)
    at = df.metadataColumn("_metadata")
    return df.withColumn(name, F.xxhash64(at["file_path"]).bitwiseXOR(at["row_index"]))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() would also change other cased letters, so runs of those are
    cut out and kept; texts without them take the short way."""
    parts = F.regexp_extract_all(text, F.lit(f"{_CASED}+|[^{_CASED}]+"), F.lit(0))
    kept = F.transform(parts, lambda p: F.when(p.rlike(f"^{_CASED}"), p).otherwise(F.lower(p)))
    return F.when(text.rlike(_CASED), F.array_join(kept, "")).otherwise(F.lower(text))


def utf8_rows(column: pa.Array) -> Iterator[bytes]:
    """The rows of an Arrow string or binary column as bytes; null is empty. No text is decoded."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from utf8_rows(chunk)
        return
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    valid, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    first = at[0]
    held = memoryview(data)[first : at[-1]].tobytes() if data is not None else b""
    nulls = column.is_null().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield b"" if nulls and nulls[i] else held[at[i] - first : at[i + 1] - first]


def tidy() -> None:
    """Gives memory that Python workers and Arrow hold without need back to the system; workers are kept
    between stages and would keep it too."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), with tidy() at the end of each task and batches of BATCH_BYTES at most (or
    one row): a batch is held several times over in Spark and in Python, and rows may be long. The session
    keeps that setting, or its own if that is smaller."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH).removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:
        conf.set(_BATCH, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        tidy()

    return df.mapInArrow(whole, schema)


def sliced(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of a string column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
            if len(edges) > 2:
                tidy()
