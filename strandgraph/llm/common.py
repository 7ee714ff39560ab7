"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.checkpoints import checkpoint_dir, cut

__all__ = ["checkpoint_dir", "cut"]

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\f\r"
#: The same as a Java / RE2 character class body.
SPACE_CLASS = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(name: str) -> str:
    """A column name as Spark's parser takes it, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct: beside it no name can clash.  ``select("row.*")`` gives them back."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared checkpoint folder and read from there, and its path for ``discard``.

    For tables with texts: compressed, and readers take only the columns they need, which ``cut`` can't do.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared store through Hadoop's file system, wherever that store is."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of jobs that nothing refers to any more.

    Its cleaner acts on the driver's garbage collections, which a loop of many
    small jobs on an almost empty heap may not cause for half an hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a table that may be broadcast: checked by counting, never assumed.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a table of few narrow columns that ``cut`` has written, with a broadcast hint if it has at most ``most`` rows; else it is shuffled."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bytes of a batch of rows that goes to a Python worker, about; a longer row is a batch of its own.
BATCH = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on batches of this session that go to Python hold about ``BATCH`` bytes; a smaller bound of the session's stays.

    By rows alone a batch has 10,000 texts or pairs of them, which each running task
    holds several times outside the JVM's heap.  The plan runs after its function has returned, so the setting stays.
    """
    held = spark.conf.get(BATCH_CONF, None)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(held) if held else 0
    if not 0 < size <= BATCH:
        spark.conf.set(BATCH_CONF, str(BATCH))


#: What empties the memos that operators keep in a Python worker.
memos: list[Callable[[], None]] = []


def drop_memos() -> None:
    """Empty this worker's memos: Spark reuses workers, and an operator without memos has no use for those of one before it."""
    for empty in memos:
        empty()


def texts_of(batch, column: str = "text", rows: int = 64) -> Iterator[str | None]:
    """The texts of an Arrow batch, a few as Python strings at a time."""
    held = batch.column(column)
    for i in range(0, len(held), rows):
        yield from held.slice(i, rows).to_pylist()


def squeezed(text: Column) -> Column:
    """``text`` without white space; null counts as empty.  Byte-wise replacing beats a regular expression here."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def fold_ascii(text: bytes) -> bytes:
    """Lower-case A-Z only: ``bytes.lower`` leaves every byte of a longer UTF-8 sequence alone."""
    return text.lower()


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8; ``bytes.split`` splits at exactly that white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
