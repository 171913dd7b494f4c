"""Round trips of the given tables through the file formats and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from cloudframe.lineage import cut_lineage, shared_folder
from cloudframe.operators import tensors
from cloudframe.queries import _data as d
from cloudframe.registry import Q, q, query
from cloudframe.skew import lookup
from cloudframe.sources import readers, writers

C = F.col
#: Raster rows in one grid file.
GRID_ROWS = 1000


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("write_pts_read_pts", d.select_sql(d.PTS, f"""SELECT cloud_id, count(*) AS n, {Q('sum(x)', 3)} AS sx, {Q('sum(round(z))', 3)} AS sz, sum((intensity * 100)::INT)::DOUBLE AS si FROM pts GROUP BY 1"""))
def write_pts_read_pts(spark, sf):
    folder = _scratch(spark)
    writers.write_pts(d.points(spark, sf).withColumn("intensity", F.round(C("intensity") * 100)), folder)
    back = readers.read_pts(spark, f"{folder}/*/*")
    back = back.withColumn("cloud_id", F.regexp_extract("path", "cloud_id=([^/]+)/", 1))
    return back.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"), q(F.sum("x"), 3).alias("sx"), q(F.sum(F.round("z")), 3).alias("sz"), F.sum("intensity").alias("si"))


@query("read_xyz", d.select_sql(d.PTS, f"SELECT point_id, x, {Q('y')} AS y, {Q('z')} AS z FROM pts"))
def read_xyz(spark, sf):
    folder = _scratch(spark)
    d.points(spark, sf).select(F.concat_ws(" ", "point_id", "x", "y", "z")).write.text(folder)
    return readers.read_xyz(spark, folder).select("point_id", "x", q("y").alias("y"), q("z").alias("z"))


@query("write_points_with_attributes", d.select_sql(d.PTS, f"SELECT point_id, x, {Q('sqrt(x*x + y*y + z*z)')} AS range, (x * 3)::BIGINT AS label FROM pts"))
def write_points_with_attributes(spark, sf):
    folder, pts = _scratch(spark), d.points(spark, sf)
    ranges = pts.select("point_id", F.sqrt(C("x") * C("x") + C("y") * C("y") + C("z") * C("z")).alias("range"))
    labels = pts.select("point_id", (C("x") * 3).cast("bigint").alias("label"))
    writers.write_points_with_attributes(pts, [ranges, labels], folder)
    return readers.load(spark, folder, "parquet").select("point_id", "x", q("range").alias("range"), "label")


@query("save_load_property", d.select_sql(d.PTS, "SELECT point_id, 'intensity' AS property, intensity FROM pts"))
def save_load_property(spark, sf):
    folder, pts = _scratch(spark), d.points(spark, sf)
    writers.save_property(pts.select("point_id", "intensity"), folder, "intensity", dataset=pts.select("point_id", "x", "y", "z"))
    values, _ = writers.load_property(spark, folder, with_dataset=True)
    return values.select("point_id", C("_property").alias("property"), "intensity")


@query("cached_table", d.select_sql(d.PTS, f"SELECT cloud_id, count(*) AS n, {Q('avg(x)', 5)} AS cx FROM pts GROUP BY 1"))
def cached_table(spark, sf):
    folder = _scratch(spark)
    build = lambda: tensors.moments(d.points(spark, sf), ["cloud_id"])
    writers.cached_table(spark, folder, "moments", {"sf": sf}, build)
    return writers.cached_table(spark, folder, "moments", {"sf": sf}, build).select("cloud_id", "n", q("cx", 5).alias("cx"))


# --- formats that this package only reads: the queries write the files as text ------------------------------------------

@query("read_projection_matrix", f"""WITH m AS (SELECT s_suppkey AS camera, list_transform(range(12), lambda i: s_acctbal + i * 0.5::DOUBLE) AS m FROM supplier)
SELECT camera, i::INT AS i, {Q('m[i + 1]')} AS value FROM (SELECT camera, m, unnest(range(12)) AS i FROM m)""")
def read_projection_matrix(spark, sf):
    """One camera per supplier, a line each, so that the number of files does not grow with the cameras."""
    folder = _scratch(spark)
    entry = lambda i: (C("s_acctbal") + i * 0.5).cast("string")
    d.table(spark, sf, "supplier").select(F.concat_ws(" ", "s_suppkey", *(entry(i) for i in range(12)))).write.text(folder)
    read = readers.read_projection_matrix(spark, folder)
    return read.select(C("img_id").cast("bigint").alias("camera"), F.posexplode("m").alias("i", "value")).select("camera", "i", q("value").alias("value"))


@query("read_asc_grid", d.select_sql(d.RASTER, f"""SELECT "row" AS grid, col, {Q('value')} AS value, 2.5::DOUBLE AS cellsize FROM raster"""))
def read_asc_grid(spark, sf):
    """One grid file per thousand raster rows, voids as nodata."""
    folder, raster = _scratch(spark), d.raster(spark, sf)
    width = raster.agg(F.max("col") + 1).first()[0] or 1
    lines = raster.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", C("value").cast("string")))).alias("_m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(C("_m")[i], F.lit("-9999"))), " ")
    lines = cut_lineage(lines.select("row", F.floor(C("row") / GRID_ROWS).alias("block"), line.alias("value")))
    blocks = lines.select("block").distinct()
    places = blocks.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(GRID_ROWS - 1)))).withColumn("row", (C("block") * GRID_ROWS + C("_o")).cast("int"))
    rows = places.join(lines.select("row", "value"), "row", "left").select("block", "_o", F.coalesce("value", F.lit(" ".join(["-9999"] * width))).alias("value"))
    head = f"ncols {width}\nnrows {GRID_ROWS}\nxllcorner 0\nyllcorner 0\ncellsize 2.5\nNODATA_value -9999"
    out = blocks.select("block", F.lit(-1).alias("_o"), F.lit(head).alias("value")).unionByName(rows).repartition("block").sortWithinPartitions("block", "_o")
    out.select("block", "value").write.partitionBy("block").text(folder)
    read, meta = readers.read_asc_grid(spark, f"{folder}/*/*")
    sized = lookup(read, meta.select(C("file").alias("raster_id"), "cellsize"), ["raster_id"])
    grid = F.regexp_extract("raster_id", "block=(-?[0-9]+)/", 1).cast("int") * GRID_ROWS + C("row")
    return sized.select(grid.alias("grid"), C("col").cast("int").alias("col"), q("value").alias("value"), "cellsize")


@query("read_normals", d.select_sql(d.PTS, f"SELECT count(*) AS n, {Q('sum(x)', 3)} AS sx, {Q('sum(y)', 3)} AS sy, {Q('sum(z)', 3)} AS sz FROM pts"))
def read_normals(spark, sf):
    folder = _scratch(spark)
    d.points(spark, sf).select(F.concat_ws(" ", "x", "y", "z")).write.text(folder)
    return readers.read_normals(spark, folder).agg(F.count(F.lit(1)).alias("n"), *(q(F.sum(f"n{a}"), 3).alias(f"s{a}") for a in "xyz"))


@query("read_ptx", d.select_sql(d.PTS, f"""SELECT cloud_id, x::INT AS scan, count(*) AS n, {Q('sum(y)', 3)} AS sy, sum((intensity * 100)::INT)::DOUBLE AS si, 4.0::DOUBLE AS trace
FROM pts WHERE x <> 0 OR y <> 0 OR z <> 0 GROUP BY 1, 2"""))
def read_ptx(spark, sf):
    """One scan file per cloud and x."""
    folder = _scratch(spark)
    pts = d.points(spark, sf).withColumn("scan", C("x").cast("int"))
    line = F.concat_ws(" ", "x", "y", "z", F.round(C("intensity") * 100).cast("int"))
    scans = pts.groupBy("cloud_id", "scan").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("\n", F.collect_list(line)).alias("rows"))
    head = F.concat(C("n").cast("string"), F.lit("\n1\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n1 0 0 0\n0 1 0 0\n0 0 1 0\n0 0 0 1\n"))
    scans.select("cloud_id", "scan", F.concat(head, C("rows")).alias("value")).repartition("cloud_id", "scan").write.partitionBy("cloud_id", "scan").text(folder)
    rows, poses = readers.read_ptx(spark, f"{folder}/*/*/*")
    trace = poses.select(C("cloud_id").alias("_c"), sum((C("m")[i] for i in (5, 10, 15)), C("m")[0]).alias("trace"))
    named = rows.join(trace, C("cloud_id") == C("_c")).select(F.regexp_extract("path", "cloud_id=([^/]+)/", 1).alias("cloud_id"), F.regexp_extract("path", "scan=([0-9]+)/", 1).cast("int").alias("scan"), "y", "intensity", "trace")
    return named.groupBy("cloud_id", "scan").agg(F.count(F.lit(1)).alias("n"), q(F.sum("y"), 3).alias("sy"), F.sum("intensity").alias("si"), F.max("trace").alias("trace"))


@query("read_many_ply", d.select_sql(d.PTS, f"""SELECT cloud_id, x::INT AS scan, count(*) AS n, {Q('sum(y)', 3)} AS sy, sum((intensity * 100)::INT)::DOUBLE AS si, false AS rejected
FROM pts GROUP BY 1, 2 UNION ALL SELECT 'broken', 0, 0, NULL, NULL, true"""))
def read_many_ply(spark, sf):
    """One scan file per cloud and x, and one file without a header, which does not stop the rest."""
    folder = _scratch(spark)
    pts = d.points(spark, sf).withColumn("scan", C("x").cast("int"))
    line = F.concat_ws(" ", F.round(C("intensity") * 100).cast("int"), "x", "y", "z")
    scans = pts.groupBy("cloud_id", "scan").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("\n", F.collect_list(line)).alias("rows"))
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), C("n").cast("string"),
                    F.lit("\nproperty float reflectance\nproperty float x\nproperty float y\nproperty float z\nend_header\n"))
    files = scans.select("cloud_id", "scan", F.concat(head, C("rows")).alias("value"))
    broken = spark.createDataFrame([("broken", 0, "no scan at all")], "cloud_id string, scan int, value string")
    files.unionByName(broken).repartition("cloud_id", "scan").write.partitionBy("cloud_id", "scan").text(folder)
    points, rejected = readers.read_many(spark, f"{folder}/*/*", "ply")
    sums = points.groupBy("path").agg(F.count(F.lit(1)).alias("n"), q(F.sum("y"), 3).alias("sy"), F.sum("intensity").alias("si"), F.lit(False).alias("rejected"))
    none = rejected.select("path", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("sy"), F.lit(None).cast("double").alias("si"), F.lit(True).alias("rejected"))
    both = sums.unionByName(none)
    return both.select(F.regexp_extract("path", "cloud_id=([^/]+)/", 1).alias("cloud_id"), F.regexp_extract("path", "scan=([0-9]+)/", 1).cast("int").alias("scan"), "n", "sy", "si", "rejected")
