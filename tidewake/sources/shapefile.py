"""Shapefiles as a Spark data source: the segments of their lines and rings.

The index file (.shx) tells where each record lies; its records are dealt out in partitions of about `split_bytes`, and a task
reads its own stretch of the .shp file alone.  With a box only records whose own bounds meet it are decoded.  Without an
index file the driver walks over the record headers.  Paths are local ones or URIs that Arrow's file systems open."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: sizes in bytes, codes of shapes with and without heights or measures.
HEADER, FILE_CODE, RECORD_HEADER = 100, 9994, 8
LINES, POLYGONS = {3, 13, 23}, {5, 15, 25}
SEGMENTS = "ring_id bigint, seq int, x1 double, y1 double, x2 double, y2 double, polygon boolean"
#: Segments of a batch.
BATCH = 1 << 16


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _checked(head: bytes, path: str) -> None:
    if len(head) < HEADER or struct.unpack(">i", head[:4])[0] != FILE_CODE:
        raise ValueError(f"{path} is no shapefile")


def record_places(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each record's header begins, and the bytes of its content."""
    system, name = _file(path)
    index = name[: -len(".shp")] + ".shx"
    with system.open_input_file(name) as f:
        _checked(f.read(HEADER), path)
        if system.get_file_info(index).type == fs.FileType.File:
            with system.open_input_file(index) as x:
                _checked(x.read(HEADER), index)
                places = np.frombuffer(x.read(), ">i4").astype(np.int64).reshape(-1, 2) * 2
            return places[:, 0], places[:, 1]
        at, size, places = HEADER, f.size(), []
        while at + RECORD_HEADER <= size:
            f.seek(at)
            content = 2 * struct.unpack(">2i", f.read(RECORD_HEADER))[1]
            places.append((at, content))
            at += RECORD_HEADER + content
    found = np.array(places, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def decode(content: bytes, number: int, box: tuple[float, float, float, float] | None) -> pa.RecordBatch | None:
    """The segments of a record; None for an empty shape and one outside the box (min_lat, max_lat, min_lon, max_lon)."""
    kind = struct.unpack("<i", content[:4])[0]
    if kind == 0:
        return None
    if kind not in LINES | POLYGONS:
        raise ValueError(f"record {number} is of type {kind}; lines and polygons only")
    x0, y0, x1, y1, n_parts, n = struct.unpack("<4d2i", content[4:44])
    if box and (y1 < box[0] or y0 > box[1] or x1 < box[2] or x0 > box[3]):
        return None
    parts = np.frombuffer(content, "<i4", n_parts, 44)
    xy = np.frombuffer(content, "<f8", 2 * n, 44 + 4 * n_parts).reshape(-1, 2).astype(float)
    part = np.searchsorted(parts, np.arange(n), "right") - 1
    own = np.flatnonzero(part[1:] == part[:-1])  # a step from one part to the next is no segment
    arrays = [(number << 32) + part[own].astype(np.int64), (own - parts[part[own]]).astype(np.int32), xy[own, 0], xy[own, 1], xy[own + 1, 0], xy[own + 1, 1]]
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array(np.full(len(own), kind in POLYGONS))], names)


@dataclass
class Stretch(InputPartition):
    first: int
    begin: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.split = int(options.get("split_bytes", 8 << 20))
        self.box = tuple(map(float, options["box"].split(","))) if options.get("box") else None
        if not self.path.endswith(".shp"):
            raise ValueError(f"{self.path!r} isn't the path of a .shp file")

    def partitions(self):
        begin, size = record_places(self.path)
        end = begin + RECORD_HEADER + size
        out, at = [], 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(end, begin[at] + self.split, "right")))
            out.append(Stretch(at, int(begin[at]), int(end[to - 1])))
            at = to
        return out or [Stretch(0, HEADER, HEADER)]

    def read(self, partition: Stretch):
        system, name = _file(self.path)
        held, rows, number = [], 0, partition.first
        with system.open_input_file(name) as f:
            f.seek(partition.begin)
            while f.tell() < partition.end:
                batch = decode(f.read(2 * struct.unpack(">2i", f.read(RECORD_HEADER))[1]), number, self.box)
                number += 1
                if batch is not None:
                    held.append(batch)
                    rows += batch.num_rows
                if rows >= BATCH:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH)
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SEGMENTS

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_shapefile(spark: SparkSession, path: str, land_only: bool = False, box: tuple[float, float, float, float] | None = None, split_bytes: int = 8 << 20) -> DataFrame:
    """ring_id, seq, x1, y1, x2, y2 of all lines and rings of a .shp file, or of its polygons' rings only.

    box leaves out records that lie outside; records without a shape have no segments; other kinds of shapes are an error."""
    spark.dataSource.register(ShapefileSource)
    reader = spark.read.format("shapefile").option("split_bytes", split_bytes)
    reader = reader.option("box", ",".join(map(repr, map(float, box)))) if box else reader
    out = reader.load(path)
    return (out.where("polygon") if land_only else out).drop("polygon")
