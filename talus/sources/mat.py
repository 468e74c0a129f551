"""Version 5 MAT files of numeric arrays as tables: soil depth, no-grow lines, strength scenarios.

Spark reads the files (any store it knows). An array goes to cells where it is read, one file in one task: the format
has no parts that could be read apart.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.operators.grid import extent

# Fixed values of the format: types of data elements, classes of arrays.
ELEMENTS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}


def _elements(data: bytes, order: str, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # type and size in one word, up to four bytes beside it
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def decode(data: bytes) -> dict[str, np.ndarray]:
    """The numeric arrays of a file by name; others are left out."""
    order = {b"IM": "<", b"MI": ">"}.get(data[126:128])
    if order is None:
        raise ValueError("not a version 5 MAT file")
    out = {}
    for kind, body in _elements(data, order, 128):
        if kind == COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind != MATRIX:
            continue
        flags, shape, name, *rest = _elements(body, order)
        of = CLASSES.get(flags[1][0 if order == "<" else 3])
        if of is None or not rest:
            continue
        values = np.frombuffer(rest[0][1], np.dtype(order + ELEMENTS[rest[0][0]]))
        sizes = np.frombuffer(shape[1], np.dtype(f"{order}i4")).tolist()
        out[name[1].decode("ascii")] = values.astype(of).reshape(sizes, order="F")
    return out


def encode(arrays: dict[str, np.ndarray]) -> bytes:
    """A file of two-dimensional arrays (booleans as bytes), each compressed."""
    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    out = [b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H2s", 0x0100, b"IM")]
    for name, a in arrays.items():
        a = np.atleast_2d(a.astype("u1") if a.dtype == bool else a)
        of = next(k for k, v in CLASSES.items() if v == a.dtype.str[1:])
        kind = next(k for k, v in ELEMENTS.items() if v == a.dtype.str[1:])
        body = element(6, struct.pack("<II", of, 0)) + element(5, struct.pack(f"<{a.ndim}i", *a.shape)) + element(1, name.encode()) + element(kind, a.tobytes(order="F"))
        packed = zlib.compress(element(MATRIX, body))
        out.append(struct.pack("<II", COMPRESSED, len(packed)) + packed)
    return b"".join(out)


def write(df: DataFrame, path: str, arrays: dict[str, str]) -> None:
    """Write columns of (r, c, columns) as a file's arrays; arrays: column by name. A file holds whole arrays, so one task makes it."""
    m, n = extent(df)
    kinds = {c: df.schema[c].dataType.simpleString() for c in arrays.values()}

    def made(key, table):  # no type hints: they would choose another form of call
        at, out = (table.column("r").to_numpy(), table.column("c").to_numpy()), {}
        for name, column in arrays.items():
            out[name] = np.full((m, n), np.nan) if kinds[column] in ("double", "float") else np.zeros((m, n), {"boolean": bool, "int": "i4", "bigint": "i8"}[kinds[column]])
            out[name][at] = table.column(column).to_numpy()
        return pa.table({"data": pa.array([encode(out)], pa.binary())})

    data = df.select("r", "c", *dict.fromkeys(arrays.values()), F.lit(0).alias("_file")).groupBy("_file").applyInArrow(made, "data binary").first()
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data.data if data else encode({})))
    out.close()


def cells(spark: SparkSession, path: str, keys: dict[str, str], needed: tuple[str, ...]) -> DataFrame:
    """(r, c, a column per key) of a file's arrays of one shape; keys: column by array name. Arrays that are not needed may be missing (null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                got = decode(content.as_py())
                if gone := [k for k in needed if k not in got]:
                    raise ValueError(f"the file has no {', '.join(gone)}")
                shape = got[needed[0]].shape
                if any(got[k].shape != shape for k in keys if k in got):
                    raise ValueError("arrays of different shapes")
                for first in range(0, shape[0], step := max(1, (1 << 18) // max(1, shape[1]))):
                    r, c = np.mgrid[first : min(first + step, shape[0]), 0 : shape[1]]
                    part = [pa.array(got[k][first : first + step].ravel().astype(float)) if k in got else pa.nulls(r.size, pa.float64()) for k in keys]
                    yield pa.RecordBatch.from_arrays([pa.array(r.ravel(), pa.int32()), pa.array(c.ravel(), pa.int32()), *part], names=["r", "c", *keys.values()])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(["r int, c int", *(f"{c} double" for c in keys.values())]))


def soil_depth(spark: SparkSession, path: str) -> DataFrame:
    """(r, c, depth)."""
    return cells(spark, path, {"depth": "depth"}, ("depth",)).withColumn("depth", F.nanvl("depth", F.lit(None).cast("double")))


def no_grow(spark: SparkSession, path: str) -> DataFrame:
    """(r, c, nogrow, ridge, valley); no ridges or valleys where the file has none."""
    got = cells(spark, path, {"nogrow_io": "nogrow", "ridge_io": "ridge", "valley_io": "valley"}, ("nogrow_io",))
    return got.select("r", "c", *(F.coalesce(F.col(k) != 0, F.lit(False)).alias(k) for k in ("nogrow", "ridge", "valley")))


def strength(spark: SparkSession, path: str) -> DataFrame:
    """(run, phi, coh, prob): runs from 1, in the file's order."""
    got = cells(spark, path, {"prob": "prob", "prob_phi": "phi", "prob_coh": "coh"}, ("prob", "prob_phi", "prob_coh"))
    return got.select((F.greatest("r", "c") + 1).alias("run"), "phi", "coh", "prob")
