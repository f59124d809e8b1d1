"""Helpers that the text operators share: the cluster's shared folder, ASCII folding, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one serves
    local mode; on a cluster that would lose rows of other executors, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="oculith-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Tables that were written and nothing has removed yet: path, and the folder's file system.
_TABLES: dict[str, tuple] = {}


def lasting(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """`df` as a Parquet table in the shared folder, and its path; removed by remove(), or at the end of the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _TABLES[path] = (own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    return spark.read.schema(df.schema).parquet(path), path


_INSIDE: list[set[str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, and survives lost executors. It is removed by the
    scratch() around it, or at the end of the driver."""
    table, path = lasting(df, label)
    for own in _INSIDE:
        own.add(path)
    return table


def remove(paths: Iterable[str]) -> None:
    for path in paths:
        own, folder = _TABLES.pop(path, (None, None))
        if own is not None:
            with suppress(Exception):  # a driver that ends may have no JVM any more
                folder.delete(own, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes what written() wrote inside, when the block ends: nothing lazy may read it afterwards."""
    _INSIDE.append(set())
    try:
        yield
    finally:
        remove(_INSIDE.pop())


@atexit.register
def _remove_all() -> None:
    remove(list(_TABLES))


def looked_up(left: DataFrame, right: DataFrame, key: str, total: int, most: int = 256) -> DataFrame:
    """left joined with right, which has one row a key and `n`, the number of left's rows with it (`total` in all).

    Keys of more than max(most, total / 100,000) rows can't be more than 100,000: they are broadcast, so that no task
    holds all rows of a hot key. `left` is read twice.
    """
    most = max(most, total // 100_000)
    hot, rest = right.filter(F.col("n") > most).drop("n"), right.filter(F.col("n") <= most).drop("n")
    common = left.join(F.broadcast(hot), key)
    return common.unionByName(left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII strings take the JVM's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_text(text: str = "text") -> Column:
    """A text column as a string that Python can read: bytes that aren't UTF-8 become U+FFFD, all others stay."""
    return F.make_valid_utf8(F.col(text).cast("string"))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo `folds`; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def numbered_columns(docs: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ...: mapInArrow() resolves no names with dots in them."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def row_order(schema: StructType, largest: bool) -> Column:
    """Order of the rows in the struct column `whole`: by doc_id, a null id losing to any other; rows with the same id are
    told apart by a hash of their columns."""
    plain = [F.col("whole")[f.name] for f in schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    doc_id = F.col("whole")["doc_id"]
    return F.struct((doc_id.isNotNull() if largest else doc_id.isNull()).alias("no_id"), doc_id.alias("doc_id"), F.xxhash64(*plain).alias("hash"))


def kept_row(schema: StructType, largest: bool) -> Column:
    """Aggregate of the struct column `whole`: the row with the largest or smallest doc_id."""
    return (F.max_by if largest else F.min_by)(F.col("whole"), row_order(schema, largest))


def one_row(rows: DataFrame, group: list[str], largest: bool) -> DataFrame:
    """Of each group one row, as kept_row() chooses; the names in `whole` can't clash with the group's.

    The row itself is carried, so repeated and null ids need no join back; copies are folded before the shuffle.
    """
    return rows.groupBy(*group).agg(kept_row(rows.schema["whole"].dataType, largest).alias("whole")).select("whole.*")
