"""What the operators share: scratch tables in the shared folder, and row annotation in Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelens.session import ensure_checkpoint_dir


#: Bytes of one Arrow batch between Spark and a worker, and of the texts that are worked on at a time.
BATCH_BYTES, PART_BYTES = 8 << 20, 1 << 20
#: Rows of one file of a small table.
PART_ROWS = 20_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, shared by driver and executors.

    Nothing is removed there: whoever owns the folder clears it, since results read from it lazily.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def prepare(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did (a cluster gets it by --py-files), and
    batches of whole texts are kept small: Spark's default of 64 MB is held several times on both sides."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(filter(None, [root, known.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives executors.

    With an upper bound of its rows, it's written by one task for each ``PART_ROWS`` of them, so that small
    tables don't become hundreds of files; more rows get more tasks.
    """
    path = scratch(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // PART_ROWS)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as a list of its UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
            "boolean": pa.bool_(), "binary": pa.binary()}[kind.simpleString()]


def slices(batch: pa.RecordBatch, rows: int, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and about ``PART_BYTES`` of text (a longer text is a part of its own)."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(np.cumsum(size[at:at + rows]), PART_BYTES, side="right"))
        yield batch.slice(at, max(1, fits))
        at += max(1, fits)


def annotate(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable], added: str,
             rows: int = 256) -> DataFrame:
    """Columns ``row`` (a struct of the columns ``keep``) and ``added``, made from column ``text``.

    ``make()`` runs once for each task and returns ``fn``; ``fn`` gets a list of UTF-8 texts (None for
    null) of at most ``rows`` rows and returns one list or Arrow array for each field of ``added``.
    Packing what is kept in a struct means that no column of the input can clash with an added one.
    Rows are independent, so a lost task is simply run again.
    """
    fields = T.StructType.fromDDL(added)
    prepare(df.sparkSession)
    kept = list(dict.fromkeys(keep))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]).alias("row"))
    schema = T.StructType([T.StructField("row", T.StructType([packed.schema["row"].dataType[c] for c in kept])), *fields])
    kinds = [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, rows, batch.column(0).field(text)):
                row = part.column(0)
                made = fn(utf8(row.field(text)))
                out = pa.StructArray.from_arrays([row.field(c) for c in kept], kept)
                yield pa.RecordBatch.from_arrays(
                    [out, *[m if isinstance(m, pa.Array) else pa.array(m, k) for m, k in zip(made, kinds, strict=True)]],
                    ["row", *fields.names])

    return packed.mapInArrow(run, schema)


def shared_prefix(a: bytes, i: int, b: bytes, j: int) -> int:
    """How many bytes of ``a`` from i on and ``b`` from j on are the same, by slices of doubling size."""
    n, most, step = 0, min(len(a) - i, len(b) - j), 8
    while n < most:
        size = min(step, most - n)
        if a[i + n:i + n + size] == b[j + n:j + n + size]:
            n, step = n + size, 2 * step
        elif size == 1:
            break
        else:
            step = size // 2
            most = n + size
    return n


def flat(df: DataFrame, keep: list[str], rest: list[str]) -> DataFrame:
    """The columns ``keep`` out of ``row``, then ``rest``."""
    return df.select(*[F.col("row")[c].alias(c) for c in keep], *rest)


def one_thread() -> None:
    """Libraries in a task use the one core that Spark gave the task."""
    for name in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS"):
        os.environ[name] = "false" if name.startswith("TOK") else "1"
