"""Label maps and images on disk as cells.

Files are read with Spark's ``binaryFile`` source, so any store that Spark reads will
do; a file is decoded in the task that holds it and leaves it as non-background cells.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Element types by their names and codes in the file formats.
_NRRD = {"signed char": "i1", "int8": "i1", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4", "longlong": "i8", "int64": "i8", "float": "f4", "double": "f8"}
_NIFTI = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8"}
_META = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_LONG": "i4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}


def _header(text: str, sep: str) -> dict[str, str]:
    lines = (line.partition(sep) for line in text.splitlines() if sep in line and not line.startswith("#"))
    return {k.strip().lower(): v.strip().lstrip("=").strip() for k, _, v in lines}


def read_nrrd(data: bytes) -> tuple[np.ndarray, list[float]]:
    head, _, body = data.partition(b"\n\n")
    fields = _header(head.decode("latin-1"), ":")
    sizes = [int(s) for s in fields["sizes"].split()]
    encoding = fields["encoding"]
    if encoding in ("gzip", "gz"):
        body = gzip.decompress(body)
    elif encoding != "raw":
        raise ValueError(f"NRRD encoding {encoding} is not read")
    kind = np.dtype(_NRRD[fields["type"]]).newbyteorder(">" if fields.get("endian") == "big" else "<")
    if "space directions" in fields:
        vectors = [v for v in fields["space directions"].split() if v != "none"]
        spacing = [float(np.linalg.norm([float(x) for x in v.strip("()").split(",")])) for v in vectors]
    else:
        spacing = [float(s) for s in fields.get("spacings", " ".join("1" for _ in sizes)).split()]
    return np.frombuffer(body, kind, int(np.prod(sizes))).reshape(sizes[::-1]), spacing[::-1]


def read_nifti(data: bytes) -> tuple[np.ndarray, list[float]]:
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dims = struct.unpack(f"{order}8h", data[40:56])
    kind = struct.unpack(f"{order}h", data[70:72])[0]
    spacing = struct.unpack(f"{order}8f", data[76:108])
    start = int(struct.unpack(f"{order}f", data[108:112])[0])
    slope, shift = struct.unpack(f"{order}2f", data[112:120])
    sizes = dims[1 : dims[0] + 1]
    out = np.frombuffer(data, np.dtype(_NIFTI[kind]).newbyteorder(order), int(np.prod(sizes)), start).reshape(sizes[::-1])
    if slope not in (0.0, 1.0) or slope and shift:
        out = out * (slope or 1.0) + shift
    return out, [float(s) for s in spacing[1 : dims[0] + 1]][::-1]


def read_mha(data: bytes) -> tuple[np.ndarray, list[float]]:
    mark = data.index(b"ElementDataFile")
    end = data.index(b"\n", mark) + 1
    fields = _header(data[:end].decode("latin-1"), "=")
    if fields["elementdatafile"] != "LOCAL":
        raise ValueError("only MHA files with their own data are read")
    body = data[end:]
    if fields.get("compresseddata", "False") == "True":
        body = zlib.decompress(body)
    sizes = [int(s) for s in fields["dimsize"].split()]
    kind = np.dtype(_META[fields["elementtype"]]).newbyteorder(">" if fields.get("binarydatabyteordermsb", "False") == "True" else "<")
    spacing = [float(s) for s in fields.get("elementspacing", " ".join("1" for _ in sizes)).split()]
    return np.frombuffer(body, kind, int(np.prod(sizes))).reshape(sizes[::-1]), spacing[::-1]


def decode(path: str, data: bytes) -> tuple[np.ndarray, list[float]]:
    """(array in z, y, x order, spacing in the same order) of a volume, by the name of its file."""
    name = path.lower()
    for suffixes, reader in (((".nrrd",), read_nrrd), ((".nii", ".nii.gz"), read_nifti), ((".mha",), read_mha)):
        if name.endswith(suffixes):
            return reader(data)
    if name.endswith(".npy"):
        array = np.load(io.BytesIO(data), allow_pickle=False)
        return array, [1.0] * array.ndim
    raise ValueError(f"no reader for {path}")


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, folder, size) of the files below a root; contents are read only where asked for."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    return found.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"), F.element_at(F.split(path, "/"), -2).alias("folder"), F.col("length").alias("size"))


def cohort(spark: SparkSession, root: str, images: str = "images", masks: str = "masks") -> DataFrame:
    """(subject, kind, role, path) of ``<root>/<images or masks>/<subject>/<role>/<file>``: of several files the first by name."""
    path = F.col("path")
    at = lambda k: F.element_at(F.split(path, "/"), k)
    rows = files(spark, root).select(at(-3).alias("subject"), at(-4).alias("kind"), at(-2).alias("role"), "path").where(F.col("kind").isin(images, masks))
    return rows.groupBy("subject", "kind", "role").agg(F.min("path").alias("path"))


def habitat_maps(spark: SparkSession, root: str, suffix: str = "_habitats.nrrd") -> DataFrame:
    """(subject, path) of the label maps below a folder, the subject being the name before the suffix."""
    found = files(spark, root, f"*{suffix}")
    return found.select(F.substring_index("name", suffix, 1).alias("subject"), "path")


def first_in_folder(spark: SparkSession, root: str, pattern: str = "*.dcm") -> DataFrame:
    """(folder, path): one file of each folder, the first by name."""
    return files(spark, root, pattern).groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.min("path").alias("path"))


CELLS = "string, z int, y int, x int, value double"

#: Rows of cells that leave a task at once.
BATCH = 1 << 16


def cells(spark: SparkSession, root: str, pattern: str = "*.nrrd", name: Column | None = None) -> DataFrame:
    """(path, z, y, x, value) of the non-zero cells of three-dimensional volumes; with ``name``, a column made of ``path``, (subject, z, y, x, value).

    The name is made once a file, before its cells.  A file that can't be decoded fails
    its task with the file's name.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    first = "path" if name is None else "subject"
    found = found.select("path", (F.col("path") if name is None else name).alias("__name"), "content")
    batch_rows = BATCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        rows = 0

        def leave() -> pa.RecordBatch:
            who, counts, *parts = zip(*held, strict=True)
            repeated = pa.array(who, pa.string()).take(pa.array(np.repeat(np.arange(len(who)), counts)))
            return pa.RecordBatch.from_arrays([repeated, *(pa.array(np.concatenate(p)) for p in parts)], names=[first, "z", "y", "x", "value"])

        for batch in batches:
            for path, called, data in zip(*(batch.column(c).to_pylist() for c in ("path", "__name", "content")), strict=True):
                try:
                    array, _ = decode(path, data)
                except Exception as error:
                    raise ValueError(f"{path}: {error}") from error
                if array.ndim != 3:
                    raise ValueError(f"{path}: {array.ndim} axes")
                step = max(1, batch_rows // max(1, array[0].size if len(array) else 1))
                for z in range(0, len(array), step):  # some slices at a time bound the rows in memory
                    part = array[z : z + step]
                    at = np.nonzero(part)
                    if len(at[0]):
                        held.append([called, len(at[0]), (at[0] + z).astype(np.int32), at[1].astype(np.int32), at[2].astype(np.int32), part[at].astype(float)])
                        rows += len(at[0])
                    if rows >= batch_rows:
                        yield leave()
                        held, rows = [], 0
        if held:
            yield leave()

    return found.mapInArrow(run, f"{first} {CELLS}")


def map_cells(spark: SparkSession, root: str, suffix: str = "_habitats.nrrd") -> DataFrame:
    """(subject, z, y, x, label) of the label maps below a folder, the subject being the file's name before the suffix; every file is found and read once."""
    name = F.element_at(F.split("path", "/"), -1)
    return cells(spark, root, f"*{suffix}", F.substring_index(name, suffix, 1)).select("subject", "z", "y", "x", F.col("value").cast("int").alias("label"))


def write_nrrd(array: np.ndarray, spacing: list[float] | None = None) -> bytes:
    """A gzip-encoded NRRD file of an array in z, y, x order."""
    names = {np.dtype(v): k for k, v in _NRRD.items()}
    spacing = spacing or [1.0] * array.ndim
    head = ["NRRD0004", f"type: {names[array.dtype]}", f"dimension: {array.ndim}", f"sizes: {' '.join(map(str, array.shape[::-1]))}", f"spacings: {' '.join(map(str, spacing[::-1]))}", "endian: little", "encoding: gzip"]
    return "\n".join(head).encode() + b"\n\n" + gzip.compress(np.ascontiguousarray(array, array.dtype.newbyteorder("<")).tobytes(), mtime=0)


_LONG = (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"UC", b"UR")


def read_tags(data: bytes, limit: int = 1 << 20) -> dict[str, str]:
    """Text of the top-level elements of a DICOM file in explicit little-endian form, by group and element in hex; pixels end the reading."""
    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    out, at = {}, 132
    while at + 8 <= min(len(data), limit):
        group, element = struct.unpack("<HH", data[at : at + 4])
        kind = data[at + 4 : at + 6]
        if (group, element) == (0x7FE0, 0x0010):
            break
        if kind in _LONG:
            size, at = struct.unpack("<I", data[at + 8 : at + 12])[0], at + 12
        else:
            size, at = struct.unpack("<H", data[at + 6 : at + 8])[0], at + 8
        if size == 0xFFFFFFFF:
            break
        raw = data[at : at + size]
        if kind in (b"US", b"UL", b"SS", b"SL") and len(raw) in (2, 4):
            out[f"{group:04x}{element:04x}"] = str(int.from_bytes(raw, "little", signed=kind[:1] == b"S"))
        elif kind not in _LONG:
            out[f"{group:04x}{element:04x}"] = raw.decode("latin-1").rstrip("\0 ")
        at += size
    return out


def tags(spark: SparkSession, root: str, pattern: str = "*.dcm") -> DataFrame:
    """(path, tags map<string, string>, error): a file that isn't readable keeps its row and says why."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[list | None] = []
            errors: list[str | None] = []
            for data in batch.column("content").to_pylist():
                try:
                    got.append(list(read_tags(data).items()))
                    errors.append(None)
                except Exception as error:
                    got.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(got, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())], names=["path", "tags", "error"])

    return found.mapInArrow(run, "path string, tags map<string,string>, error string")


#: Files that the driver writes at once where tasks can't.
WRITERS = 16


def write_maps(cells: DataFrame, folder: str, subject: str = "subject", label: str = "label", suffix: str = "_habitats.nrrd") -> int:
    """Write each subject's label map (z, y, x, label) as ``<folder>/<subject><suffix>``; the number of files.

    A subject's cells fit in one task by definition of a volume.  In a mounted folder the
    task writes the file itself, under another name first, so that a repeated task leaves
    a whole file; in a store that only Spark's file systems open, the driver writes some
    files at a time.
    """
    import pandas as pd

    spark = cells.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    root = hadoop.Path(folder)
    uri = root.getFileSystem(conf).makeQualified(root).toUri()
    mounted = uri.getPath() if uri.getScheme() == "file" else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["z", "y", "x"]].to_numpy()
        grid = np.zeros(at.max(0) + 1, np.int16)
        grid[tuple(at.T)] = pdf["label"]
        name, data = str(pdf["name"].iloc[0]), write_nrrd(grid)
        if mounted is None:
            return pd.DataFrame({"name": [name], "data": [data]})
        path = f"{mounted}/{name}{suffix}"
        place, last = os.path.split(path)
        os.makedirs(place, exist_ok=True)
        part = f"{place}/.{last}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        with contextlib.suppress(FileNotFoundError):
            os.remove(f"{place}/.{last}.crc")  # the checksum of an earlier file of the name
        return pd.DataFrame({"name": [name], "data": [None]})

    named = cells.select(F.col(subject).cast("string").alias("name"), "z", "y", "x", F.col(label).cast("int").alias("label"))
    rows = named.groupBy("name").applyInPandas(run, "name string, data binary")
    if mounted is not None:
        return rows.agg(F.count("*")).first()[0]

    def send(r) -> None:
        path = hadoop.Path(f"{folder}/{r['name']}{suffix}")
        out = path.getFileSystem(conf).create(path, True)
        try:
            out.write(bytearray(r["data"]))
        finally:
            out.close()

    n = 0
    with ThreadPoolExecutor(WRITERS) as pool:
        for some in itertools.batched(rows.toLocalIterator(prefetchPartitions=True), 64 * WRITERS):
            n += sum(1 for _ in pool.map(send, some))
    return n
