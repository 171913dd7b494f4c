"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cloudframe.lineage import shared_folder, shuffles_removed

C = F.col

#: Parts into which the rows of one key are dealt before they meet, so that no task gets more than a 32nd of a hot key.
SALTS = 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase)))


def salt(*columns: str | Column, salts: int = SALTS) -> Column:
    """A part number that spreads the rows of a hot key evenly and is the same whenever it is computed."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (Spark compares them without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def summary_by_group(rows: DataFrame, keys: list[str], spread: list[str], aggregates: dict[str, tuple[str, str]],
                     salts: int = SALTS) -> DataFrame:
    """``rows`` with aggregates of their group, for groups of any size.

    ``aggregates`` maps a new column to ``(function, column)`` with a function that merges: ``min``, ``max`` or ``sum``.
    Rows are dealt by ``keys`` and a salt of ``spread``, summed up per part, the at most ``salts`` parts of a group are
    summed up again, and what comes out is joined by key *and* salt: no join or aggregation sees more than one part of a
    hot group at a time.  NULL is a key like any other.
    """
    merge = {"min": F.min, "max": F.max, "sum": F.sum}
    dealt = rows.withColumn("_salt", salt(*spread, salts=salts))
    parts = dealt.groupBy(*keys, "_salt").agg(*[merge[f](c).alias(n) for n, (f, c) in aggregates.items()])
    whole = parts.groupBy(*keys).agg(*[merge[f](n).alias(n) for n, (f, _) in aggregates.items()],
                                     F.collect_list("_salt").alias("_salts"))
    back = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return join_null_safe(dealt, back, [*keys, "_salt"]).drop("_salt")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL meets NULL; the key columns of ``left`` stay."""
    names = {k: f"_right_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    condition = None
    for k, n in names.items():
        one = left[k].eqNullSafe(renamed[n])
        condition = one if condition is None else condition & one
    return left.join(renamed, condition, how).drop(*([] if how in ("left_semi", "left_anti") else names.values()))


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``rows`` with ``table`` (one row per key), for keys that any share of ``rows`` may have.

    The parts of a key that occur in ``rows`` (``salts`` at most) first fetch what ``table`` has for it; then rows and
    parts meet by key and salt.
    """
    dealt = rows.withColumn("_salt", salt(*spread, salts=salts))
    parts = dealt.select(*keys, "_salt").distinct()
    return join_null_safe(dealt, join_null_safe(parts, table, keys, "left" if how == "left" else "inner"), [*keys, "_salt"], how).drop("_salt")


def text_key(text: str) -> Column:
    """Tells apart rows that share one document id."""
    return F.xxhash64(F.coalesce(C(text), F.lit("")))


def rows_of(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str, how: str = "left_semi", once: bool = False) -> DataFrame:
    """The rows of ``docs`` named in ``chosen`` (``_id, _hash``), with the columns of ``docs``; ``once``: repeated rows once."""
    row, key, copy = fresh(docs, "row_id", "text_hash", "copy_no")
    # NULL meets NULL inside a struct, and copies are numbered where the join has put them: the texts move once.
    named = chosen.select(F.struct(C("_id").cast(docs.schema[doc_id].dataType).alias("id")).alias(row), C("_hash").alias(key))
    out = docs.withColumns({row: F.struct(C(doc_id).alias("id")), key: text_key(text)}).join(named, [row, key], how)
    if once:
        out = out.withColumn(copy, F.row_number().over(Window.partitionBy(row, key).orderBy(key))).where(C(copy) == 1)
    return out.select(*docs.columns)


def first_by_hash(rows: DataFrame, key: str, unique: list[str], n: int) -> DataFrame:
    """At most ``n`` rows of each ``key``, the first by a hash of ``unique``, with ``_no`` from 1 (for few keys).

    Hashes are spread evenly, so the first ``n`` of a key lie, but for a chance of one in 10**15, below the bound that a
    few more than ``n`` of its rows lie below; only these are sorted.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    place = F.xxhash64(*unique) / F.lit(2.0 ** 64) + 0.5
    near = rows.join(F.broadcast(sizes), key).where(place * C("_size") <= n + 8 * n ** 0.5 + 16).drop("_size")
    order = Window.partitionBy(key).orderBy(F.xxhash64(*unique), *unique)
    return near.withColumn("_no", F.row_number().over(order)).where(C("_no") <= n)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to a new folder in the shared checkpoint folder and read again, and the folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``written`` has made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
