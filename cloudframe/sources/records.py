"""Binary scan files of fixed-size records as a Spark data source: each partition is a range of the records of one file.

The header of a file is read once, by a task; the ranges follow from it.  So a file of any size is read by many tasks, and a
task that is lost reads only its range again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

C = F.col
#: Records of a partition, and of a batch within it.
RANGE, CHUNK = 1_000_000, 100_000
#: Bytes that are read at a time while the end of a header is looked for, and the most that a header may have.
HEAD, LONGEST_HEAD = 1 << 14, 1 << 24
# Numeric types of the PLY format and the little-endian NumPy types they stand for.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8",
             "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}


def open_file(path: str) -> pa.NativeFile:
    """A file by the path that Spark lists for it."""
    if path.startswith("file:"):
        return pa.OSFile("/" + path[len("file:"):].lstrip("/"))
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def las_layout(path: str) -> dict:
    """Where the records of a LAS file (versions 1.0 to 1.4, point formats 0 to 10) lie and what they hold."""
    with open_file(path) as file:
        head, length = file.read_at(375, 0), file.size()
    if head[104] & 0xC0 or head[104] & 0x3F > 10:
        raise ValueError(f"{path}: not an uncompressed LAS file of point format 0 to 10")
    number = lambda kind, at: np.frombuffer(head, kind, 1, at)[0].item()
    count = number("<u4", 107)
    if head[24:26] >= b"\x01\x04":  # a 64-bit count; the old field may be 0
        count = number("<u8", 247) or count
    at_class, mask = (16, 255) if head[104] & 0x3F >= 6 else (15, 31)
    if number("<u2", 105) <= at_class or number("<u4", 96) + count * number("<u2", 105) > length:
        raise ValueError(f"{path}: too short for {count} records")
    scaled = {axis: [4 * i, "<i4", number("<f8", 131 + 8 * i), number("<f8", 155 + 8 * i)] for i, axis in enumerate("xyz")}
    return {"form": "binary", "start": number("<u4", 96), "size": number("<u2", 105), "count": count, "mask": mask,
            "fields": {**scaled, "intensity": [12, "<u2", 1.0, 0.0], "label": [at_class, "u1", 1.0, 0.0]}}


def ply_layout(path: str) -> dict:
    """The same of the vertices of a PLY file; for ASCII files ``start`` is the line of the first vertex."""
    with open_file(path) as file:
        head, end = b"", -1
        while end < 0:
            more = file.read(HEAD)
            head += more
            at = head.find(b"end_header")
            end = head.find(b"\n", at) if at >= 0 else -1
            if end < 0 and (not more or len(head) > LONGEST_HEAD):
                raise ValueError(f"{path}: no PLY header")
    lines = [line.split() for line in head[:end].decode("ascii").splitlines() if line.strip()]
    form, element, elements = "", "", {}
    for words in lines:
        if words[0] == "format":
            form = words[1]
        elif words[0] == "element":
            element = words[1]
            elements[element] = [int(words[2]), []]
        elif words[0] == "property":
            elements[element][1].append(words[1:])
    if next(iter(elements), "") != "vertex" or any(len(p) != 2 or p[0] not in PLY_TYPES for p in elements["vertex"][1]):
        raise ValueError(f"{path}: vertices of plain properties have to come first")
    if form not in ("ascii", "binary_little_endian"):
        raise ValueError(f"{path}: format {form!r} is not read")
    count, properties = elements["vertex"]
    fields, size = {}, 0
    for i, (kind, name) in enumerate(properties):
        fields[name] = [i if form == "ascii" else size, PLY_TYPES[kind], 1.0, 0.0]
        size += np.dtype(PLY_TYPES[kind]).itemsize
    return {"form": "ascii" if form == "ascii" else "binary", "start": len(lines) if form == "ascii" else end + 1, "size": size, "count": count, "fields": fields}


LAYOUTS = {"las": las_layout, "ply": ply_layout}


def layouts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``path, file, layout, error``: one row per file of a file, folder or glob; a header that cannot be read gives an error text."""
    listed = spark.read.format("binaryFile").load(path).select("path", C("_metadata.file_path").alias("file"))  # names only

    def read(batches):
        for batch in batches:
            found, errors = [], []
            for one in batch["path"]:
                try:
                    found.append(json.dumps(LAYOUTS[kind](one)))
                    errors.append(None)
                except (ValueError, IndexError, OSError) as error:
                    found.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield batch.assign(layout=found, error=errors)

    return listed.mapInPandas(read, "path string, file string, layout string, error string")


@dataclass
class RecordRange(InputPartition):
    path: str
    layout: dict
    first: int
    count: int


class RecordReader(DataSourceReader):
    def __init__(self, files: list, names: list[str], size: int):
        self.files, self.names, self.size = files, names, size

    def partitions(self) -> list[RecordRange]:
        parts = [RecordRange(path, layout, at, min(self.size, layout["count"] - at))
                 for path, layout in self.files for at in range(0, layout["count"], self.size)]
        return parts or [RecordRange("", {}, 0, 0)]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        layout, end = partition.layout, partition.first + partition.count
        fields = layout["fields"]
        kind = np.dtype({"names": list(fields), "formats": [f[1] for f in fields.values()], "offsets": [f[0] for f in fields.values()], "itemsize": layout["size"]})
        with open_file(partition.path) as file:
            for at in range(partition.first, end, CHUNK):
                n = min(CHUNK, end - at)
                data = file.read_at(n * layout["size"], layout["start"] + at * layout["size"])
                if len(data) < n * layout["size"]:
                    raise ValueError(f"{partition.path}: ends before record {at + n}")
                table = np.frombuffer(data, kind, n)
                columns = [pa.array([partition.path] * n, pa.string()), pa.array(np.arange(at, at + n), pa.int64())]
                for name in self.names:
                    if name not in fields:
                        columns.append(pa.nulls(n, pa.float64()))
                    elif name == "label" and "mask" in layout:
                        columns.append(pa.array((table[name] & layout["mask"]).astype("f8")))
                    else:
                        columns.append(pa.array(table[name].astype("f8") * fields[name][2] + fields[name][3]))
                yield pa.RecordBatch.from_arrays(columns, ["path", "point_id", *self.names])


class RecordSource(DataSource):
    """Options: ``files`` (JSON of paths and layouts), ``names`` (JSON of the columns) and ``records`` (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "scan_records"

    def schema(self) -> str:
        return "path string, point_id long, " + ", ".join(f"`{n}` double" for n in json.loads(self.options["names"]))

    def reader(self, schema) -> RecordReader:
        return RecordReader(json.loads(self.options["files"]), json.loads(self.options["names"]), int(self.options["records"]))


def read_records(spark: SparkSession, files: list, names: list[str], records: int = RANGE) -> DataFrame:
    """``path, point_id`` and the fields ``names`` (NULL where a file has none) of binary files with their layouts."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("scan_records").option("files", json.dumps(files)).option("names", json.dumps(names)).option("records", str(records)).load()
