"""Ingestion of many NIfTI-1 files into two tables: `volumes` (one row a file) and `voxels` (one row a voxel).

Headers are read as binary rows. Voxels come through a data source, `volume_slices`, with a row for each slice: files are
dealt in ranges of bytes, and a task reads the slices that begin in its range, so a big file is many tasks'. Compressed
files can't be entered in the middle: each is one task's. A file that can't be decoded gives a row of `volumes` with `error`
and no voxels. Tasks open files by pyarrow's file systems (local, HDFS, S3 and others by the path's scheme).
"""

from __future__ import annotations

import gzip
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VOLUMES = "path string, dims array<int>, pixdim array<double>, affine array<array<double>>, error string"
VOXELS = "path string, i int, j int, k int, value double"
#: Fixed values of the format: data type code to numpy type.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def header(raw: bytes) -> dict:
    """Byte order, size, spacing, affine (sform, else qform, else spacing alone) and data layout of a file's header."""
    if len(raw) < 348:
        raise ValueError("shorter than a header")
    order = next((o for o in "<>" if struct.unpack_from(o + "i", raw, 0)[0] == 348), None)
    if order is None:
        raise ValueError("not a NIfTI-1 header")
    get = lambda form, at: struct.unpack_from(order + form, raw, at)
    n = get("8h", 40)
    pix = get("8f", 76)
    code, at, slope, inter = get("h", 70)[0], get("3f", 108)[0], *get("2f", 112)
    if code not in TYPES:
        raise ValueError(f"data type {code} isn't supported")
    dims, spacing = [max(d, 1) for d in n[1:4]], [float(p) for p in pix[1:4]]
    qform, sform = get("2h", 252)
    affine = np.diag([*spacing, 1.0])
    if sform > 0:
        affine[:3] = np.array(get("12f", 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *shift = (float(v) for v in get("6f", 256))
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        affine[:3, :3] = turn * np.array([spacing[0], spacing[1], spacing[2] * (-1.0 if pix[0] < 0 else 1.0)])
        affine[:3, 3] = shift
    return {"dims": dims, "pixdim": spacing, "affine": affine.tolist(), "type": order + TYPES[code], "offset": int(at), "slope": slope or 1.0, "intercept": inter if slope else 0.0}


def unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def files(spark: SparkSession, path: str, glob: str = "*.nii*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def volumes(spark: SparkSession, path: str) -> DataFrame:
    """path, dims, pixdim, affine, error; one row a file."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    h = header(unpacked(content))
                    row = (name, h["dims"], h["pixdim"], h["affine"], None)
                except (ValueError, OSError, EOFError) as e:
                    row = (name, None, None, None, str(e))
                yield pd.DataFrame([row], columns=["path", "dims", "pixdim", "affine", "error"])

    return files(spark, path).mapInPandas(decode, VOLUMES)


SLICES = "path string, k int, width int, height int, content array<double>"
#: Bytes of a file that one task reads, and of a header.
RANGE_BYTES, HEADER_BYTES = 64 << 20, 352


@dataclass
class Range(InputPartition):
    """Bytes low to high (the last excluded) of a file."""

    path: str
    low: int
    high: int


class SliceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob, self.size = options["path"], options.get("glob", "*.nii*"), int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        folder, base = fs.FileSystem.from_uri(self.path)
        found = folder.get_file_info(base)
        files_ = [found] if found.is_file else folder.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        files_ = sorted((f.path, f.size) for f in files_ if f.is_file and fnmatch(posixpath.basename(f.path), self.glob))
        size = lambda path, n: n if path.endswith(".gz") else self.size
        return [Range(path, low, low + size(path, n)) for path, n in files_ for low in range(0, n, max(1, size(path, n)))]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file at all
            return
        folder, _ = fs.FileSystem.from_uri(self.path)
        scheme = self.path.split(":", 1)[0] if ":" in self.path else "file"
        name = f"{scheme}:{part.path}" if scheme == "file" else f"{scheme}://{part.path.lstrip('/')}"
        with folder.open_input_file(part.path) as f:
            head = f.read_at(min(HEADER_BYTES, f.size()), 0)
            try:
                whole = unpacked(f.read_at(f.size(), 0)) if head[:2] == b"\x1f\x8b" else None
                if whole is not None and part.low > 0:
                    return  # compressed under another name: the first range has it all
                h = header(head if whole is None else whole)
            except (ValueError, OSError, EOFError, struct.error):
                return
            nx, ny, nz = h["dims"]
            step = nx * ny * np.dtype(h["type"]).itemsize
            for k in range(nz):
                at = h["offset"] + k * step
                if whole is None and not part.low <= at < part.high:
                    continue
                raw = whole[at : at + step] if whole is not None else f.read_at(step, at)
                if len(raw) < step:
                    return  # cut off: the slices before it stand
                content = np.frombuffer(raw, h["type"]).astype(float) * h["slope"] + h["intercept"]
                yield pa.record_batch({"path": pa.array([name]), "k": pa.array([k], pa.int32()), "width": pa.array([nx], pa.int32()), "height": pa.array([ny], pa.int32()), "content": pa.ListArray.from_arrays(pa.array([0, len(content)], pa.int32()), pa.array(content))})


class VolumeSlices(DataSource):
    """Slices of volume files below `path`. Options: glob (*.nii*), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "volume_slices"

    def schema(self) -> str:
        return SLICES

    def reader(self, schema: object) -> DataSourceReader:
        return SliceReader({k.lower(): v for k, v in self.options.items()})


def slices(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, k (from 0), width, height, content (along i, then j) of every slice of every readable file. A file that is cut
    off has the slices before the cut."""
    spark.dataSource.register(VolumeSlices)
    return spark.read.format("volume_slices").option("rangeBytes", range_bytes).load(path)


def voxels(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, i, j, k (from 0), value of every voxel of every readable file."""
    each = slices(spark, path, range_bytes).select("path", "k", "width", F.posexplode("content").alias("at", "value"))
    return each.select("path", (F.col("at") % F.col("width")).alias("i"), F.floor(F.col("at") / F.col("width")).cast("int").alias("j"), "k", "value")


def written_header(dims: list[int], pixdim: list[float], affine: list[list[float]]) -> bytes:
    """Header of a file of doubles with this size, spacing and affine."""
    out = bytearray(HEADER_BYTES)
    put = lambda form, at, *values: struct.pack_into("<" + form, out, at, *values)
    put("i", 0, 348)
    put("8h", 40, 3, *dims, 1, 1, 1, 1)
    put("2h", 70, 64, 64)
    put("8f", 76, 1.0, *pixdim, 0, 0, 0, 0)
    put("3f", 108, float(HEADER_BYTES), 1.0, 0.0)
    put("2h", 252, 0, 1)
    put("12f", 280, *[v for row in affine[:3] for v in row])
    out[344:348] = b"n+1\x00"
    return bytes(out)


def write_volumes(voxels: DataFrame, volumes: DataFrame, path: str) -> DataFrame:
    """Writes a file for each volume_id (with dims, pixdim, affine) of its voxels' values, 0 where there is none, and returns
    volume_id, path. A task holds one volume's given voxels and one slice; a file gets its name once it is whole, so tasks
    that are run again do no harm. Voxels outside their volume are left out."""

    def write(part: pd.DataFrame) -> pd.DataFrame:
        own = part.iloc[0]
        nx, ny, nz = (int(n) for n in own["dims"])
        folder, base = fs.FileSystem.from_uri(path)
        folder.create_dir(base, recursive=True)
        name = f"{base}/volume-{own['volume_id']}.nii"
        inside = part["i"].between(0, nx - 1) & part["j"].between(0, ny - 1) & part["k"].between(0, nz - 1)
        given = part[inside].sort_values("k")
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        with folder.open_output_stream(draft) as f:
            f.write(written_header([nx, ny, nz], list(own["pixdim"]), [list(r) for r in own["affine"]]))
            ends = np.searchsorted(given["k"].to_numpy(), np.arange(nz + 1))
            for low, high in zip(ends, ends[1:]):
                slab = np.zeros((ny, nx))
                rows = given.iloc[low:high]
                slab[rows["j"].to_numpy(int), rows["i"].to_numpy(int)] = rows["value"].to_numpy(float)
                f.write(slab.tobytes())
        folder.move(draft, name)
        return pd.DataFrame({"volume_id": [own["volume_id"]], "path": [name]})

    each = volumes.select("volume_id", "dims", "pixdim", "affine").join(voxels.select("volume_id", "i", "j", "k", "value"), "volume_id", "left")
    return each.groupBy("volume_id").applyInPandas(write, "volume_id long, path string")


def slice_matrix(voxels: DataFrame, plane: str, number: int) -> DataFrame:
    """Voxels of one slice (number from 1); empty for a slice that isn't there."""
    return voxels.filter(F.col({"AXIAL": "k", "SAGITTAL": "i", "CORONAL": "j"}[plane]) == number - 1)


def spaced_slices(n: int, most: int = 9) -> list[int]:
    """Up to nine equally spaced slice numbers, rounded half to even."""
    count = min(most, n)
    return [1] if count == 1 else [round(1 + i * (n - 1) / (count - 1)) for i in range(count)]
