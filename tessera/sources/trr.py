"""Binary full-precision trajectories (TRR): frames of one size, read as records that split between tasks.

A TRR file is a sequence of frames in big-endian XDR: a header with the sizes of the blocks that follow, then box,
positions, velocities and forces in single or double precision. A run writes the same blocks in each frame, so all
frames are as long as the first; the file is read as records of that length through Hadoop, from any store that Spark
reads, and cut between tasks at frames.
"""

from __future__ import annotations

import dataclasses
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

#: Fixed values of the format.
MAGIC, NAME = 1993, b"GMX_trn_file"
SIZES = ("ir", "e", "box", "vir", "pres", "top", "sym", "x", "v", "f")
HEADER_BYTES = 4 * (3 + 3 + len(SIZES) + 3)  # up to and with nre; time and lambda follow


@dataclasses.dataclass(frozen=True)
class Header:
    sizes: dict[str, int]
    sites: int
    step: int

    @property
    def real(self) -> str:
        """The NumPy type of the frame's numbers."""
        size = self.sizes["box"] // 9 if self.sizes["box"] else self.sizes["x"] // max(1, 3 * self.sites)
        if size not in (4, 8):
            raise ValueError(f"numbers of {size} bytes in a TRR frame")
        return f">f{size}"

    @property
    def frame_bytes(self) -> int:
        return HEADER_BYTES + 2 * np.dtype(self.real).itemsize + sum(self.sizes.values())


def read_header(data: bytes) -> Header:
    """The header at the start of `data`; ValueError where no frame starts there."""
    if len(data) < HEADER_BYTES:
        raise ValueError("a TRR frame is cut short")
    magic, _, length = struct.unpack_from(">iii", data)
    if magic != MAGIC or length != len(NAME) or data[12 : 12 + length] != NAME:
        raise ValueError("no TRR frame starts here: frames differ in size, or this is another format")
    numbers = struct.unpack_from(f">{len(SIZES) + 3}i", data, 12 + len(NAME))
    return Header(dict(zip(SIZES, numbers, strict=False)), numbers[-3], numbers[-2])


def decode(data: bytes) -> dict[str, np.ndarray | int | float]:
    """step, time, box (3 x 3), and x and f (sites x 3; None where the frame has none) of one frame."""
    head = read_header(data)
    real, at = np.dtype(head.real), HEADER_BYTES
    out: dict = {"step": head.step, "time": float(np.frombuffer(data, real, 1, at)[0])}
    at += 2 * real.itemsize
    for name in SIZES:
        size = head.sizes[name]
        block = np.frombuffer(data, real, size // real.itemsize, at) if size and name in ("box", "x", "f") else None
        at += size
        if name in ("box", "x", "f"):
            out[name] = None if block is None else block.astype(float).reshape(-1, 3)
    return out


def encode(step: int, time: float, box: np.ndarray, x: np.ndarray, f: np.ndarray | None = None, double: bool = False) -> bytes:
    """One frame's bytes."""
    real = ">f8" if double else ">f4"
    blocks = {"box": np.asarray(box), "x": np.asarray(x)} | ({} if f is None else {"f": np.asarray(f)})
    raw = {k: v.astype(real).tobytes() for k, v in blocks.items()}
    sizes = [len(raw.get(k, b"")) for k in SIZES]
    head = struct.pack(">iii", MAGIC, len(NAME) + 1, len(NAME)) + NAME + struct.pack(f">{len(SIZES) + 3}i", *sizes, len(x), step, 0)
    return head + np.array([time, 0.0]).astype(real).tobytes() + b"".join(raw[k] for k in SIZES if k in raw)


def _lengths(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the file, or of the files of the folder or pattern."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for top in store.globStatus(where) for s in (store.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return [(s.getPath().getName(), s.getLen()) for s in found]


def read_trr(spark: SparkSession, path: str) -> DataFrame:
    """A TRR file as one row for each site: frame_id (from 1, in file order), timestep, time, lx, ly, lz, site_id (from 0), x, y, z, fx, fy, fz.

    Boxes must be rectangular; positions are wrapped into them. Frames without forces give null forces. Frames must be
    of one size, that of the first: ValueError for files of another length; a frame of another kind fails its task. A task holds one frame at a time.
    """
    context = spark.sparkContext
    ship(spark)
    start = b"".join(context.binaryRecords(path, 4).take(HEADER_BYTES // 4))
    size = read_header(start).frame_bytes
    if odd := [name for name, length in _lengths(spark, path) if length % size]:
        raise ValueError(f"TRR frames differ in size: {odd[0]} is not made of frames of {size} bytes")
    frames = context.binaryRecords(path, size).zipWithIndex().map(lambda r: (r[1] + 1, r[0]))
    names = ["frame_id", "timestep", "time", "lx", "ly", "lz", "site_id", "x", "y", "z", "fx", "fy", "fz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = decode(data.as_buffer().to_pybytes())
                box = got["box"]
                if np.abs(box - np.diag(np.diag(box))).max() > 1e-6:
                    raise ValueError(f"the box of frame {number} is not rectangular")
                side = np.diag(box)
                x = got["x"] - side * np.floor(got["x"] / side)
                n = len(x)
                same = lambda v, kind, n=n: pa.array(np.full(n, v), kind)
                forces = [pa.array(got["f"][:, k]) if got["f"] is not None else pa.nulls(n, pa.float64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([same(number, pa.int32()), same(got["step"], pa.int64()), same(got["time"], pa.float64()), *[same(s, pa.float64()) for s in side], pa.array(np.arange(n)), *[pa.array(x[:, k]) for k in range(3)], *forces], names)

    kinds = "frame_id int, timestep long, time double, lx double, ly double, lz double, site_id long, x double, y double, z double, fx double, fy double, fz double"
    return spark.createDataFrame(frames, "frame long, data binary").mapInArrow(run, kinds)
