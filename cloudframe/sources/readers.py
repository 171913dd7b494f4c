"""Scan, raster and matrix files as tables.  Every reader takes a file, a folder or a glob.

Text formats are read line by line from splittable files; where a format counts lines, lines are numbered split by split
(the running totals of the splits are one small table).  Binary formats are read by ranges of records.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.skew import lookup
from cloudframe.sources import records

C = F.col


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line (0, 1, ..), t ARRAY<STRING>`` of all non-empty lines, in file order."""
    raw = spark.read.text(path).select(
        F.trim("value").alias("value"), C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_id")).where(F.length("value") > 0)
    counts = raw.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"))  # one row per split
    earlier = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("file", "_at").orderBy("_id")
    return (raw.withColumn("_row", F.row_number().over(within) - 1).join(offsets, ["file", "_at"])
            .select("file", (C("_before") + C("_row")).alias("line"), F.split("value", r"\s+").alias("t")))


def _number(i: int, kind: str = "double") -> Column:
    return F.get("t", F.lit(i)).cast(kind)


def _point_columns() -> list[Column]:
    """x, y, z, intensity (from four values on) and r, g, b (from seven on)."""
    wide = F.size("t")
    return [_number(0).alias("x"), _number(1).alias("y"), _number(2).alias("z"), F.when(wide >= 4, _number(3)).alias("intensity"),
            *(F.when(wide >= 7, _number(4 + i, "int")).alias(c) for i, c in enumerate("rgb"))]


def _sections(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Give every line its section: ``section`` (1, 2, ..) and ``first`` line.  ``starts`` (file, first) is one row per section."""
    order = Window.partitionBy("file").orderBy("first")
    spans = starts.select("file", "first", F.lead("first").over(order).alias("_next"), F.row_number().over(order).alias("section"))
    return lines.join(spans, "file").where((C("line") >= C("first")) & (C("_next").isNull() | (C("line") < C("_next")))).drop("_next")


def read_pts(spark: SparkSession, path: str, merge: bool = True) -> DataFrame:
    """Blocks of a count line and ``x y z [i [r g b]]`` lines.  With ``merge`` the files of the path form one cloud and lines
    are read without an order; otherwise ``cloud_id`` is ``file#block``."""
    if merge:
        lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"), C("_metadata.file_path").alias("path"))
        return lines.where(F.size("t") >= 3).select("path", *_point_columns())
    lines = numbered_lines(spark, path)
    starts = lines.where(F.size("t") == 1).select("file", C("line").alias("first"))
    rows = _sections(lines, starts).where(F.size("t") >= 3)
    return rows.select(F.concat_ws("#", "file", "section").alias("cloud_id"), (C("line") - C("first") - 1).alias("point_id"), *_point_columns(), C("file").alias("path"))


def read_ptx(spark: SparkSession, path: str, remove_empty: bool = True) -> tuple[DataFrame, DataFrame]:
    """(points, poses): scans of two size lines, four scanner lines, a 4x4 matrix and rows; ``remove_empty`` drops rows
    whose three coordinates are all zero, the mark of a missing return (one zero coordinate is a place like any other)."""
    lines = numbered_lines(spark, path)
    single = lines.where(F.size("t") == 1).withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    starts = single.where(C("_k") % 2 == 1).select("file", C("line").alias("first"))
    placed = _sections(lines, starts).withColumns({"cloud_id": F.concat_ws("#", "file", "section"), "_o": C("line") - C("first")})
    rows = placed.where(C("_o") >= 10).select("cloud_id", (C("_o") - 10).alias("point_id"), *_point_columns(), C("file").alias("path"))
    if remove_empty:
        rows = rows.where((C("x") != 0) | (C("y") != 0) | (C("z") != 0))
    matrix = placed.where(C("_o").between(6, 9)).groupBy("cloud_id").agg(F.sort_array(F.collect_list(F.struct("_o", "t"))).alias("_m"))
    poses = matrix.select("cloud_id", F.transform(F.flatten(F.transform("_m", lambda r: r["t"])), lambda v: v.cast("double")).alias("m"))
    return rows, poses


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """``name x y z`` lines; missing numbers become 0."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t"), C("_metadata.file_path").alias("path")).where(F.size("t") > 1)
    return lines.select(C("t")[0].alias("point_id"), *(F.coalesce(_number(i), F.lit(0.0)).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))), "path")


def read_normals(spark: SparkSession, path: str) -> DataFrame:
    """Three columns; ``point_id`` is the line number, to be joined to points numbered alike."""
    return numbered_lines(spark, path).select("file", C("line").alias("point_id"), _number(0).alias("nx"), _number(1).alias("ny"), _number(2).alias("nz"))


def read_asc_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(raster, meta): ESRI ASCII grids of six header lines and rows; nodata cells are left out."""
    lines = numbered_lines(spark, path)
    header = lines.where(C("line") < 6).select("file", F.lower(C("t")[0]).alias("k"), C("t")[1].cast("double").alias("v"))
    meta = header.groupBy("file").agg(*(F.max(F.when(C("k") == k, C("v"))).alias(k) for k in ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize")),
                                      F.max(F.when(C("k").startswith("nodata"), C("v"))).alias("nodata"))  # one row per file
    meta = cut_lineage(meta)
    rows = lines.where(C("line") >= 6).select("file", (C("line") - 6).cast("int").alias("row"), F.posexplode("t").alias("col", "v"))
    cells = lookup(rows.select("file", "row", "col", C("v").cast("double").alias("value")), meta.select("file", "nodata"), ["file"])
    return cells.where(C("nodata").isNull() | (C("value") != C("nodata"))).select(C("file").alias("raster_id"), "row", "col", "value"), meta


def read_projection_matrix(spark: SparkSession, path: str) -> DataFrame:
    """3x4 camera matrices: ``img_id, m ARRAY(12)``.  A file holds one matrix of three lines (``img_id`` is the file) or any
    number of lines of a name and twelve numbers (``img_id`` is the name, with or without a colon)."""
    lines = numbered_lines(spark, path)
    whole = lambda values: F.transform(values, lambda v: v.cast("double")).alias("m")
    named = lines.where(F.size("t") == 13).select(F.rtrim(C("t")[0], F.lit(":")).alias("img_id"), whole(F.slice("t", 2, 12)))
    rows = lines.where((C("line") < 3) & (F.size("t") != 13)).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "t"))).alias("_m"))
    return rows.select(C("file").alias("img_id"), whole(F.flatten(F.transform("_m", lambda r: r["t"])))).unionByName(named)


def _layouts(spark: SparkSession, path: str, kind: str, rejected: bool) -> tuple[list, list, DataFrame]:
    """Layouts of the binary files, of the ASCII files (one short row per file each), and the table of rejected files."""
    rows = cut_lineage(records.layouts(spark, path, kind))
    bad = rows.where(C("error").isNotNull()).select("path", "error")
    first = None if rejected else bad.first()
    if first is not None:
        raise ValueError(first["error"])
    found = [(r["path"], r["file"], json.loads(r["layout"])) for r in rows.where(C("error").isNull()).orderBy("path").collect()]
    return [f for f in found if f[2]["form"] == "binary"], [f for f in found if f[2]["form"] == "ascii"], bad


def read_ply(spark: SparkSession, path: str, attributes: tuple[str, ...] = (), records_per_task: int = records.RANGE) -> DataFrame:
    """Vertices of ASCII and little-endian binary PLY files; ``reflectance`` becomes intensity, ``attributes`` are kept.

    Binary files are read by ranges of records, ASCII files by splits of lines, so one file may be read by many tasks.
    """
    binary, text, _ = _layouts(spark, path, "ply", False)
    return _ply(spark, binary, text, attributes, records_per_task)


def _ply(spark: SparkSession, binary: list, text: list, attributes: tuple[str, ...], records_per_task: int) -> DataFrame:
    names = ["x", "y", "z", "reflectance", *attributes]
    out = records.read_records(spark, [(p, layout) for p, _, layout in binary], names, records_per_task)
    if text:
        heads = spark.createDataFrame([(p, f, h["start"], h["count"], {n: v[0] for n, v in h["fields"].items()}) for p, f, h in text],
                                      "path string, file string, _start long, _count long, _at map<string,int>")
        lines = numbered_lines(spark, [p for p, _, _ in text]).join(heads, "file")
        lines = lines.withColumn("point_id", C("line") - C("_start")).where((C("point_id") >= 0) & (C("point_id") < C("_count")))
        out = out.unionByName(lines.select("path", "point_id", *(F.get("t", F.element_at("_at", F.lit(n))).cast("double").alias(n) for n in names)))
    return out.withColumnRenamed("reflectance", "intensity")


def read_las(spark: SparkSession, path: str, records_per_task: int = records.RANGE) -> DataFrame:
    """Coordinates, intensity and class of uncompressed LAS files (versions 1.0 to 1.4, point formats 0 to 10), by ranges of records.

    Compressed or unknown formats raise an error instead of giving no rows.
    """
    binary, _, _ = _layouts(spark, path, "las", False)
    return _las(spark, binary, records_per_task)


def _las(spark: SparkSession, binary: list, records_per_task: int) -> DataFrame:
    out = records.read_records(spark, [(p, layout) for p, _, layout in binary], ["x", "y", "z", "intensity", "label"], records_per_task)
    return out.withColumn("label", C("label").cast("long"))


def read_many(spark: SparkSession, path: str, form: str, records_per_task: int = records.RANGE) -> tuple[DataFrame, DataFrame]:
    """(points, rejected): all PLY or LAS files of a folder or glob, each point with its ``path``, and ``path, error`` of the
    files whose header cannot be read, which do not stop the others."""
    if form not in records.LAYOUTS:
        raise ValueError(f"unknown format {form!r}")
    binary, text, bad = _layouts(spark, path, form, True)
    return (_ply(spark, binary, text, (), records_per_task) if form == "ply" else _las(spark, binary, records_per_task)), bad


def load(spark: SparkSession, path: str, form: str | None = None, **options) -> DataFrame:
    """Read points by format, taken from the extension when not given; stored tables are Parquet folders."""
    form = form or (path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet")
    readers = {"pts": read_pts, "xyz": read_xyz, "ply": read_ply, "las": read_las,
               "ptx": lambda s, p, **o: read_ptx(s, p, **o)[0], "asc": lambda s, p: read_asc_grid(s, p)[0],
               "parquet": lambda s, p: s.read.parquet(p)}
    if form not in readers:
        raise ValueError(f"unknown format {form!r}")
    return readers[form](spark, path, **options)
