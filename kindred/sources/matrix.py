"""Saved matrices (NPY files, members of NPZ files) as a Spark source, and a sink that publishes them in checked chunks.

Reading: the driver lists files with their sizes, nothing else. A file is cut into pieces by its size; each task reads the
header, finds its own rows and reads their bytes alone. Writing: a table dealt to chunks is written chunk by chunk, each
as a values file, a keys file and, last, a sidecar with their digests, so a chunk is there whole or not at all. A run that
was ended half-way is run again: chunks whose sidecar is that of the rows at hand, and whose files still have the
digests it names, are left as they are. The table counts as written when the manifest is there.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kindred.operators.keys import global_rank

#: Bytes of a piece of a file, rows of a chunk, rows that a task hands on at once.
PIECE, CHUNK, BATCH = 64 << 20, 1 << 16, 1024
MANIFEST = "manifest.json"
ROWS = "file string, member string, row long, v array<double>"
CHUNKS = "chunk long, row long, key long, v array<double>"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and place of the data of an NPY stream at its start."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(f)
    if len(shape) not in (1, 2) or kind.kind not in "fiu" or (fortran and len(shape) == 2 and min(shape) > 1):
        raise ValueError(f"not a row-wise matrix of numbers: {shape} {kind}")
    return shape, kind, f.tell()


def _rows(f, piece: int, pieces: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(first row, rows)`` of one of some equal pieces of an NPY stream, BATCH rows at a time."""
    shape, kind, data = _header(f)
    dim = shape[1] if len(shape) == 2 else 1
    first, last = shape[0] * piece // pieces, shape[0] * (piece + 1) // pieces
    wide = dim * kind.itemsize
    f.seek(data + first * wide)
    for at in range(first, last, BATCH):
        n = min(BATCH, last - at)
        raw = f.read(n * wide)
        if len(raw) != n * wide:
            raise ValueError(f"the matrix ends within row {at + len(raw) // max(wide, 1)} of {shape[0]}")
        yield at, np.frombuffer(raw, dtype=kind).reshape(n, dim)


@dataclass
class Piece(InputPartition):
    path: str
    piece: int
    pieces: int


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes, self.finite = options["path"], int(options.get("piece_bytes", PIECE)), options.get("finite", "true") == "true"

    def partitions(self):
        fs, path = _at(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(path)) if x.is_file and x.path.endswith((".npy", ".npz"))]
        cut = lambda x: max(1, -(-x.size // self.bytes))
        return [Piece(x.path, i, cut(x)) for x in sorted(files, key=lambda x: x.path) for i in range(cut(x))]

    def read(self, partition: Piece):
        fs, _ = _at(self.path)
        with fs.open_input_file(partition.path) as f:
            if partition.path.endswith(".npz"):
                with zipfile.ZipFile(f) as z:
                    for name in sorted(z.namelist()):
                        with z.open(name) as member:
                            yield from self._batches(member, partition, name.removesuffix(".npy"))
            else:
                yield from self._batches(f, partition, None)

    def _batches(self, f, partition: Piece, member: str | None):
        for at, x in _rows(f, partition.piece, partition.pieces):
            x = np.ascontiguousarray(x, dtype=np.float64)
            if self.finite and not np.isfinite(x).all():
                raise ValueError(f"{partition.path}: not finite")
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)[: len(x) + 1], pa.array(x.ravel()))
            name = pa.array([partition.path] * len(x), pa.string())
            yield pa.RecordBatch.from_arrays([name, pa.array([member] * len(x), pa.string()), pa.array(at + np.arange(len(x))), flat], ["file", "member", "row", "v"])


@dataclass
class Written(WriterCommitMessage):
    """Chunks, rows, chunks that were there before, and the sum of the chunks' digests as numbers: of one size however many chunks."""

    chunks: int
    rows: int
    reused: int
    digest: int


def npy_bytes(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(x), allow_pickle=False)
    return out.getvalue()


def _digest(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path = options["path"]

    def write(self, iterator):
        fs, root = _at(self.path)
        fs.create_dir(root, recursive=True)
        done, chunk, parts = [0, 0, 0, 0], None, []

        def flush():
            if chunk is not None:
                for i, v in enumerate(self._publish(fs, root, chunk, pa.Table.from_batches(parts))):
                    done[i] += v

        for b in iterator:
            at = b["chunk"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if at[i] != chunk:
                    flush()
                    chunk, parts = int(at[i]), []
                parts.append(b.slice(i, j - i))
        flush()
        return Written(*done[:3], done[3] % (1 << 256))

    def _publish(self, fs: pafs.FileSystem, root: str, chunk: int, rows: pa.Table) -> tuple[int, int, int, int]:
        rows = rows.sort_by("row")
        keys = rows["key"].to_numpy()
        values = rows["v"].combine_chunks()
        values = (values.chunk(0) if isinstance(values, pa.ChunkedArray) else values).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(keys), -1)
        files = {"values": npy_bytes(values), "keys": npy_bytes(np.column_stack([keys >> 32, keys & 0xFFFFFFFF]).astype("<i8"))}  # halves: components are read as doubles
        note = {"chunk": chunk, "rows": len(keys), "dim": values.shape[1]} | {f"{k}_sha256": _digest(b) for k, b in files.items()}
        name = f"{root}/chunk-{chunk:010d}"
        number = int(_digest(json.dumps(note, sort_keys=True).encode()), 16)
        if self._there(fs, name, note):
            return 1, len(keys), 1, number
        for kind, b in files.items():
            self._put(fs, f"{name}.{kind}.npy", b)
        self._put(fs, f"{name}.json", json.dumps(note, sort_keys=True).encode())
        return 1, len(keys), 0, number

    @staticmethod
    def _there(fs: pafs.FileSystem, name: str, note: dict) -> bool:
        try:
            with fs.open_input_file(f"{name}.json") as f:
                if json.loads(f.read()) != note:
                    return False
            for kind in ("values", "keys"):
                with fs.open_input_file(f"{name}.{kind}.npy") as f:
                    if _digest(f.read()) != note[f"{kind}_sha256"]:
                        return False
        except (FileNotFoundError, ValueError):
            return False
        return True

    @staticmethod
    def _put(fs: pafs.FileSystem, path: str, b: bytes) -> None:
        """Whole or not at all: another task that writes the same chunk writes the same bytes."""
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temp) as f:
            f.write(b)
        fs.move(temp, path)

    def commit(self, messages):
        fs, root = _at(self.path)
        own = [m for m in messages if m is not None]
        note = {"chunks": sum(m.chunks for m in own), "rows": sum(m.rows for m in own), "digest": f"{sum(m.digest for m in own) % (1 << 256):064x}", "reused": sum(m.reused for m in own)}
        fs.create_dir(root, recursive=True)
        self._put(fs, f"{root}/{MANIFEST}", json.dumps(note, sort_keys=True).encode())

    def abort(self, messages):
        """Chunks that are whole stay for the next run."""


class MatrixSource(DataSource):
    """``spark.read.format("matrix")``: rows of matrices. ``df.write.format("matrix")``: rows (chunk, row, key, v), dealt by chunk."""

    @classmethod
    def name(cls):
        return "matrix"

    def schema(self):
        return ROWS

    def reader(self, schema):
        return MatrixReader(self.options)

    def writer(self, schema, overwrite):
        return ChunkWriter(self.options, overwrite)


def read_matrix(spark: SparkSession, path: str, piece_bytes: int = PIECE, finite: bool = True) -> DataFrame:
    """``(file, member, row, v)`` of an NPY or NPZ file, or of all in a folder; ``member`` is null for NPY files.

    Matrices of one or two dimensions, row-wise, of integers or floats; components come as doubles. Others raise, and so do
    files that end early and, unless ``finite`` is false, components that are not finite. An empty matrix has no rows.
    """
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("piece_bytes", str(piece_bytes)).option("finite", str(finite).lower()).load(path)


def write_matrix(rows: DataFrame, key: str, vector: str, path: str, chunk_rows: int = CHUNK) -> dict:
    """Write ``(key, vector)`` in the order of keys (unique longs) as chunks of ``chunk_rows`` rows; returns the manifest.

    Rows with a null key or vector are left out; vectors of different lengths in a chunk, or with null components, raise.
    Running it again on the same rows rewrites only what is missing or broken.
    """
    spark = rows.sparkSession
    spark.dataSource.register(MatrixSource)
    fine = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    dealt = global_rank(fine, [F.col("key")]).withColumn("chunk", F.floor((F.col("rk") - 1) / chunk_rows).cast("long"))
    dealt = dealt.select("chunk", (F.col("rk") - 1).cast("long").alias("row"), "key", "v")
    dealt.repartition("chunk").sortWithinPartitions("chunk", "row").write.format("matrix").mode("append").save(path)
    return manifest(path)


def manifest(path: str) -> dict:
    fs, root = _at(path)
    with fs.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(key, v)`` of what ``write_matrix`` wrote; keys meet values by chunk and row."""
    m = read_matrix(spark, path, finite=False)
    part = lambda kind: m.where(F.col("file").endswith(f".{kind}.npy")).select(F.regexp_extract("file", r"chunk-(\d+)\.", 1).alias("chunk"), "row", F.col("v").alias(kind))
    half = lambda i: F.get("keys", F.lit(i)).cast("long")
    return part("keys").join(part("values"), ["chunk", "row"]).select(F.shiftleft(half(0), 32).bitwiseOR(half(1)).alias("key"), F.col("values").alias("v"))
