"""Results that several parts of a query, several queries or several runs read, as tables in the shared folder.

stored() writes a table for the query at hand. kept() finds a table again by what it was made from: name, parameters, and the
files (path, size, time of change) of the input tables. A query on the same files reads it, a changed file misses it. The
store lies in `spark.oculith.store`, where it lasts; where that is unset, in the shared folder, until the driver ends. Beyond
`spark.oculith.store.bytes` (64 GiB unless set) the tables that weren't used for longest go.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="oculith-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table: what reads it doesn't work it out again, and lost executors don't lose it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """Has a folder removed at the end."""
    _TABLES[path] = _folder(spark, path)


#: Changes when the rows of kept tables would be other ones from the same input.
EDITION = 1
STORE, STORE_BYTES = "spark.oculith.store", "spark.oculith.store.bytes"
_IN_USE: set[str] = set()


def _folder(spark: SparkSession, path: str) -> tuple:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and time of change of all files at a path or below it, in order."""
    own, folder = _folder(spark, path)
    found, out = folder.listFiles(own, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def set_times(spark: SparkSession, paths: list[str]) -> None:
    """Gives files times of change that follow their order, a second apart, the last one now."""
    for k, path in enumerate(reversed(paths)):
        own, folder = _folder(spark, path)
        folder.setTimes(own, int((time.time() - k) * 1000), -1)


def store_folder(spark: SparkSession) -> str:
    root = spark.conf.get(STORE, None)
    if not root:
        root = f"{shared_folder(spark)}/store"
        keep(spark, root)
    return root


def kept(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
    """The table that `build` makes from the input paths: read from the store, or worked out and written there first."""
    made_of = [EDITION, name, sorted((k, repr(v)) for k, v in parameters.items()), [files_of(spark, p) for p in inputs]]
    path = f"{store_folder(spark)}/{name}-{hashlib.sha256(json.dumps(made_of).encode()).hexdigest()[:32]}"
    own, folder = _folder(spark, path)
    _IN_USE.add(path)
    if folder.exists(own):
        with suppress(Exception):  # a store without times of use goes by times of writing
            folder.setTimes(own, int(time.time() * 1000), -1)
        return spark.read.parquet(path)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    keep(spark, draft)
    build().write.parquet(draft)
    if not folder.rename(_folder(spark, draft)[0], own) and not folder.exists(own):
        raise OSError(f"{draft} can't become {path}")
    _bounded(spark)
    return spark.read.parquet(path)


def _bounded(spark: SparkSession) -> None:
    """Removes the tables that weren't used for longest, until the store has room; never one that this driver has read."""
    root = store_folder(spark)
    own, folder = _folder(spark, root)
    most = int(spark.conf.get(STORE_BYTES, str(64 << 30)))
    tables = sorted((f.getModificationTime(), f.getPath().toString(), folder.getContentSummary(f.getPath()).getLength()) for f in folder.listStatus(own) if not f.getPath().getName().endswith(".draft"))
    total, used = sum(size for *_, size in tables), {p.split("/")[-1] for p in _IN_USE}
    for _, path, size in tables:
        if total <= most:
            break
        if path.split("/")[-1] not in used:
            folder.delete(_folder(spark, path)[0], True)
            total -= size


@atexit.register
def clear() -> None:
    """Removes all stored tables; frames that read them must not be used afterwards."""
    _IN_USE.clear()
    for path in list(_TABLES):
        own, folder = _TABLES.pop(path)
        with suppress(Exception):  # a driver that ends may have no JVM any more
            folder.delete(own, True)
