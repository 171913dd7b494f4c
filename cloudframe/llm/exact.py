"""Exact deduplication by deterministic block naming (Karp, Miller and Rosenberg 1972), in DataFrame functions only.

Texts are cut into blocks of a fixed size.  Equal blocks get the same integer name by sorting, never by a hash alone;
then adjacent names are paired and the pairs are named in the same way, level by level, until one name is left for each
document.  Two documents have the same name on the same level if and only if their texts are equal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.llm import common
from cloudframe.llm.common import C

#: Characters of a block.
BLOCK = 2048
#: Sorting runs within 2**16 hash buckets, so that it is spread over any number of tasks.  Bucket and rank make the name.
BUCKETS = 1 << 16
RANK_BITS = 46


def named(rows: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """``rows`` with ``name`` (bigint), equal for equal ``keys`` and different for different ones, instead of ``keys``.

    Rows are dealt by bucket and salt and ranked there; of every distinct key in a part one row goes on to be ranked
    in its whole bucket; the (small) table of part rank and whole rank then renames the rows.  A key that a third of all
    rows share is ranked in ``SALTS`` parts and counts as ``SALTS`` rows afterwards.
    """
    others = [c for c in rows.columns if c not in keys]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) * common.SALTS + common.salt(*spread))
    inside = Window.partitionBy("_part").orderBy(*keys)
    ranked = dealt.withColumn("_local", F.shiftleft(C("_part"), 40) + F.dense_rank().over(inside))
    # A condition that always holds, on all columns: so both uses of the dealt rows need the same columns, and Spark
    # shuffles them once for both.
    same = F.xxhash64(*others) % 2 < 2
    first = (ranked.withColumn("_before", F.lag("_local").over(inside)).where(~C("_before").eqNullSafe(C("_local")) & same)
             .select(F.floor(C("_part") / common.SALTS).alias("_bucket"), "_local", *keys))
    whole = Window.partitionBy("_bucket").orderBy(*keys)
    names = first.select("_local", (F.shiftleft(C("_bucket"), RANK_BITS) + F.dense_rank().over(whole)).alias("name"))
    return ranked.select(*others, "_local").join(names, "_local").drop("_local")


def document_names(docs: DataFrame, doc_id: str, text: str, block: int = BLOCK) -> DataFrame:
    """Identity of each distinct (doc_id, text): ``_id, _hash, level, name``.

    ``_hash`` only tells apart texts that share one ``doc_id``; it plays no part in which texts count as equal.
    """
    rows = docs.select(C(doc_id).alias("_id"), F.coalesce(C(text), F.lit("")).alias("_text"))
    blocks = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    rows = (rows.withColumn("_hash", F.xxhash64("_text")).withColumn("_blocks", blocks)
            .withColumn("_blocks", F.when(F.size("_blocks") == 0, F.array(F.lit(""))).otherwise(C("_blocks")))
            .select("_id", "_hash", F.size("_blocks").alias("_n"), F.posexplode("_blocks").alias("_i", "_block")))
    current = cut_lineage(named(rows, ["_block"], ["_id", "_hash"]))
    longest = current.agg(F.max("_n")).first()[0] or 1
    done = [current.where("_n = 1").select("_id", "_hash", F.lit(0).alias("level"), "name")]
    for level in range(1, math.ceil(math.log2(longest)) + 1):
        half = F.shiftright(C("_i"), 1)
        pairs = (current.where("_n > 1").groupBy("_id", "_hash", "_n", half.alias("_half"))
                 .agg(F.max(F.when(C("_i") % 2 == 0, C("name"))).alias("_a"), F.max(F.when(C("_i") % 2 == 1, C("name"))).alias("_b"))
                 .select("_id", "_hash", F.shiftright(C("_n") + 1, 1).alias("_n"), C("_half").alias("_i"), "_a", "_b"))
        current = cut_lineage(named(pairs, ["_a", "_b"], ["_id", "_hash", "_i"]))
        done.append(current.where("_n = 1").select("_id", "_hash", F.lit(level).alias("level"), "name"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates(["_id", "_hash"])


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, level, name``.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the row with the largest ``doc_id`` stays
    (of repeated rows with that id: exactly one; NULL ids come last).  A NULL text counts as empty, and all empty texts
    form one group.  Other columns are not looked at; an empty table gives an empty result.
    """
    rows = docs.select(C(doc_id).alias("_id"), common.ascii_lower(F.coalesce(C(text), F.lit(""))).alias("_text"))
    names = document_names(rows, "_id", "_text", block)
    plain = rows.select("_id", F.xxhash64("_text").alias("_hash"), F.sha2("_text", 256).alias("text_sha256"))
    joined = common.join_null_safe(plain, names, ["_id", "_hash"]).withColumn("_one", F.lit(1).cast("bigint"))
    out = common.summary_by_group(joined, ["level", "name"], ["_id"], {"keep_id": ("max", "_id"), "group_size": ("sum", "_one")})
    copy = F.row_number().over(Window.partitionBy("level", "name", "_id").orderBy("_hash"))
    return out.select(C("_id").alias("doc_id"), "keep_id", "group_size",
                      (C("_id").eqNullSafe(C("keep_id")) & (copy == 1)).alias("kept"), "text_sha256", "level", "name")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group of equal texts."""
    key, copy = common.fresh(docs, "text_hash", "copy_no")
    kept = exact_groups(docs, doc_id, text).where("kept").select(C("doc_id").alias("_id"), C("text_sha256").alias("_sha"))
    normal: Column = F.sha2(common.ascii_lower(F.coalesce(C(text), F.lit(""))), 256)
    rows = docs.withColumn(key, normal)
    kept = kept.withColumnsRenamed({"_id": doc_id, "_sha": key})
    out = common.join_null_safe(rows, kept, [doc_id, key], "left_semi")
    return (out.withColumn(copy, F.row_number().over(Window.partitionBy(doc_id, key).orderBy(key)))
            .where(C(copy) == 1).select(*docs.columns))
