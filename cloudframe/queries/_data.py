"""The given tables seen as points, rasters and curves, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cloudframe.registry import Q

C = F.col


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- points: one per lineitem ---------------------------------------------------------------------------------------

def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("point_id"),
        C("l_returnflag").alias("cloud_id"), C("l_quantity").alias("x"), (C("l_extendedprice") / 2000.0).alias("y"),
        (C("l_discount") * 100.0).alias("z"), C("l_tax").alias("intensity"))


def spread_points(spark: SparkSession, sf: str) -> DataFrame:
    """The points laid out over all cores before a distance join multiplies them (the given table is one file, one split)."""
    return points(spark, sf).repartition("x", "y", "z")


PTS = """pts AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS point_id,
         l_returnflag AS cloud_id, l_quantity AS x, l_extendedprice / 2000.0::DOUBLE AS y,
         l_discount * 100.0::DOUBLE AS z, l_tax AS intensity
  FROM lineitem)"""


def edges_sql(radius: float, source: str = "pts", name: str = "edges", dims: str = "xyz", strict: bool = False,
              left: str | None = None, extra: str = "") -> str:
    """CTEs for all pairs of a radius neighbourhood (distance 0 left out unless ``left`` differs from ``source``)."""
    left = left or source
    cell = lambda a: f"floor({a} / {radius}::DOUBLE)::BIGINT"
    grid = ", ".join(f"{cell(d)} AS c{d}" for d in dims)
    offsets = " CROSS JOIN ".join(f"(SELECT unnest([-1, 0, 1]) AS o{d})" for d in dims)
    squares = " + ".join(f"(b.{d} - a.{d}) * (b.{d} - a.{d})" for d in dims)
    deltas = ", ".join(f"b.{d} - a.{d} AS d{d}" for d in dims)
    match = " AND ".join(f"b.c{d} = a.c{d} + a.o{d}" for d in dims)
    zero = "" if left != source else "dist > 0 AND "
    return f"""{name}_l AS (SELECT *, {grid} FROM {left} CROSS JOIN {offsets}),
{name}_r AS (SELECT *, {grid} FROM {source}),
{name} AS MATERIALIZED (SELECT * FROM (
  SELECT a.point_id, b.point_id AS nid, {deltas}, sqrt({squares}) AS dist{extra}
  FROM {name}_l a JOIN {name}_r b ON {match}) WHERE {zero}dist {'<' if strict else '<='} {radius}::DOUBLE)"""


# --- small points: one per embedding --------------------------------------------------------------------------------

def small_points(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda i: C("embedding")[i].cast("double")
    return table(spark, sf, "embeddings").select(C("vec_id").alias("point_id"), e(0).alias("x"), e(1).alias("y"),
                                                 e(2).alias("z"), C("label").cast("bigint").alias("label"))


SMALL = """pts AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
  embedding[3]::DOUBLE AS z, label::BIGINT AS label FROM embeddings)"""


# --- raster: user x day, mean event value ---------------------------------------------------------------------

def raster(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "events")
            .groupBy(C("user_id").cast("int").alias("row"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("int").alias("col"))
            .agg(F.avg("value").alias("value")))


RASTER = """raster AS (SELECT user_id::INT AS "row", date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS col, avg(value) AS value
  FROM events GROUP BY 1, 2)"""


# --- curves: one polyline per user over time --------------------------------------------------------------------------

def curves(spark: SparkSession, sf: str) -> DataFrame:
    """``curve_id, seq, x (hours), y``.  The position in the curve is counted day by day, so that a user with a very
    large share of the events is numbered by many tasks."""
    events = table(spark, sf, "events").select(
        C("user_id").alias("curve_id"), "event_id", "ts", C("value").alias("y"), F.to_date("ts").alias("_day"))
    per_day = events.groupBy("curve_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("curve_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_day.select("curve_id", "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("curve_id", "_day").orderBy("ts", "event_id")
    hours = (F.unix_micros(C("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")))
    return (events.withColumn("_rank", F.row_number().over(within)).join(offsets, ["curve_id", "_day"])
            .select("curve_id", (C("_before") + C("_rank") - 1).cast("bigint").alias("seq"),
                    (hours / 3.6e9).alias("x"), "y"))


CURVES = """curves AS (SELECT user_id AS curve_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))::DOUBLE / 3.6e9::DOUBLE AS x, value AS y FROM events)"""


def select_sql(ctes: list[str] | str, body: str) -> str:
    """One statement from CTEs and a body; the body may begin with further CTEs after a comma."""
    ctes = [ctes] if isinstance(ctes, str) else ctes
    return "WITH " + ",\n".join(ctes) + "\n" + body


# --- covariance tensors of neighbourhoods -------------------------------------------------------------------------------

def tensors_sql(source: str = "pts") -> str:
    """CTE with the tensor of every point of ``source``: the identity below three neighbours."""
    entries = ", ".join(f"CASE WHEN count(nid) < 3 THEN {int(a == b)} ELSE sum(d{a} * d{b}) / count(nid) END AS c{a}{b}"
                        for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
    return f"""tensors AS (SELECT point_id, count(nid) AS n, {entries}
  FROM {source} LEFT JOIN edges USING (point_id) GROUP BY point_id)"""


TENSORS = tensors_sql()


def every(oracle: str, **columns) -> str:
    """The rows of ``oracle`` and one for each point that it lacks, with the given values (None: NULL)."""
    values = ", ".join(f"o.{c}" if v is None else f"coalesce(o.{c}, {v}) AS {c}" for c, v in columns.items())
    return f"WITH {PTS}, o AS ({oracle})\nSELECT pts.point_id, {values} FROM pts LEFT JOIN o USING (point_id)"


def eigen_sql(source: str = "tensors", name: str = "eig", vectors: bool = False) -> str:
    """CTEs that add l1 <= l2 <= l3 (and unit axes px..pz of l1, sx..sz of l3) to a table with cxx .. czz."""
    zero = lambda e: f"CASE WHEN abs({e}) <= 1e-8 THEN 0 ELSE {e} END"
    text = f"""{name}_a AS (SELECT *, (cxx + cyy + czz) / 3 AS tq FROM {source}),
{name}_b AS (SELECT *, sqrt(((cxx - tq) ** 2 + (cyy - tq) ** 2 + (czz - tq) ** 2
    + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS tp FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN tp > 0 THEN acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
    ((cxx - tq) * ((cyy - tq) * (czz - tq) - cyz * cyz) - cxy * (cxy * (czz - tq) - cyz * cxz)
     + cxz * (cxy * cyz - (cyy - tq) * cxz)) / (2 * tp * tp * tp)))) / 3 ELSE pi() / 6 END AS phi FROM {name}_b),
{name}_d AS (SELECT *, tq + 2 * tp * cos(phi) AS t3, tq + 2 * tp * cos(phi + 2 * pi() / 3) AS t1 FROM {name}_c),
{name}{'_e' if vectors else ''} AS (SELECT *, {zero('t1')} AS l1, {zero('3 * tq - t1 - t3')} AS l2,
    {zero('t3')} AS l3 FROM {name}_d)"""
    if not vectors:
        return text
    current = f"{name}_e"
    for prefix, value in (("p", "l1"), ("s", "l3")):
        a, b, c = f"(cxx - {value})", f"(cyy - {value})", f"(czz - {value})"
        crosses = [(f"cxy * cyz - cxz * {b}", f"cxz * cxy - {a} * cyz", f"{a} * {b} - cxy * cxy"),
                   (f"cxy * {c} - cxz * cyz", f"cxz * cxz - {a} * {c}", f"{a} * cyz - cxy * cxz"),
                   (f"{b} * {c} - cyz * cyz", f"cyz * cxz - cxy * {c}", f"cxy * cyz - {b} * cxz")]
        cols = ", ".join(f"{e} AS u{i}{d}" for i, v in enumerate(crosses) for e, d in zip(v, "xyz"))
        length = lambda i: f"(u{i}x * u{i}x + u{i}y * u{i}y + u{i}z * u{i}z)"
        text += f""",
{name}_{prefix}1 AS (SELECT *, {cols} FROM {current}),
{name}_{prefix}2 AS (SELECT *, {length(0)} AS w0, {length(1)} AS w1, {length(2)} AS w2 FROM {name}_{prefix}1),
{name}_{prefix}3 AS (SELECT *, sqrt(greatest(w0, w1, w2)) AS wl,
    """ + ", ".join(f"CASE WHEN w0 >= w1 AND w0 >= w2 THEN u0{d} WHEN w1 >= w2 THEN u1{d} ELSE u2{d} END AS v{d}"
                    for d in "xyz") + f""" FROM {name}_{prefix}2),
{name}_{prefix}4 AS (SELECT *, CASE WHEN wl > 6e-6 * tp * tp THEN wl END AS wn FROM {name}_{prefix}3),
{name}_{prefix}5 AS (SELECT * EXCLUDE (""" + ", ".join(f"u{i}{d}" for i in range(3) for d in "xyz") + f""", w0, w1, w2, wl),
    CASE WHEN abs(vz / wn) > 1e-9 THEN sign(vz) WHEN abs(vy / wn) > 1e-9 THEN sign(vy)
         WHEN vx < 0 THEN -1 ELSE 1 END AS sg FROM {name}_{prefix}4),
{name}_{prefix} AS (SELECT * EXCLUDE (vx, vy, vz, wn, sg), sg * vx / wn AS {prefix}x, sg * vy / wn AS {prefix}y,
    sg * vz / wn AS {prefix}z FROM {name}_{prefix}5)"""
        current = f"{name}_{prefix}"
    return text + f",\n{name} AS (SELECT * FROM {current})"
