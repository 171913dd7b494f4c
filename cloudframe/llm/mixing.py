"""Mixing sources to target weights: fixed-length blocks, multinomial counts per output shard, index permutations.

The words of a source, its documents one after another, are packed into blocks of fixed length.  Each source has a quota
of draws.  The draws are spread over the output shards by a multinomial, so that given its size the sources of a shard
are a multinomial sample by quota, while the totals meet the targets to the word.  Draw ``d`` of a source is slot
``d mod blocks`` of epoch ``d div blocks``; a pseudorandom permutation of that epoch maps the slot to a block, and blocks
and draws meet by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.llm import common
from cloudframe.llm.common import C
from cloudframe.ordering import global_rank

#: Words of a block, blocks of an output shard (about), most epochs of a source.
BLOCK, SHARD, MOST_EPOCHS = 256, 4096, 3
#: Parts of a source that are laid out one after another.
CHUNKS = 4096
_KEY = ["_rank", "_id", "_hash", "_copy"]


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    rows = docs.select(C(doc_id).alias("_id"), common.text_key(text).alias("_hash"), C(source).alias("_source"), C(text).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len((t.as_py() or b"").split()) for t in batch.column(3)]  # bytes.split() knows ASCII blanks only
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64())], ["_id", "_hash", "_source", "_size"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"_id {kinds['_id']}, _hash bigint, _source {kinds['_source']}, _size bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``_source, _rank, _total, _target`` of each source of ``sizes`` (``_source, _size``).

    Sources by code point, NULL last, weigh 1, 2, 3, 1, .. and share the total size.  No target is above ``MOST_EPOCHS``
    times its source's size; the excess goes to the others by weight.  All shares lie at one level per weight, which is
    raised until the targets add up: one aggregation a round, two numbers each.
    """
    sources = sizes.groupBy("_source").agg(F.sum("_size").alias("_total")).withColumn("_null", C("_source").isNull())
    sources = cut_lineage(global_rank(sources, ["_null", "_source"], "_rank"))
    sources = sources.withColumn("_weight", (C("_rank") - 1) % 3 + 1).withColumn("_most", (C("_total") * MOST_EPOCHS).cast("double"))
    total, weights = sources.agg(F.sum("_total"), F.sum("_weight")).first()
    level, before = float(total or 0) / float(weights or 1), None
    while level != before:
        stopped = C("_most") < C("_weight") * level
        spent, left = sources.agg(F.sum(F.when(stopped, C("_most"))), F.sum(F.when(~stopped, C("_weight")))).first()
        before, level = level, (float(total or 0) - (spent or 0.0)) / left if left else level
    return sources.select("_source", "_rank", "_total", F.least(C("_most"), C("_weight") * level).alias("_target"))


def placed(docs: DataFrame, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the place of their first word in their source (``_at``), and the sources."""
    sized = cut_lineage(_sized(docs, doc_id, text, source))
    sources = cut_lineage(source_targets(sized))
    rows = common.lookup(sized, sources.select("_source", "_rank"), ["_source"], ["_id", "_hash"]).drop("_source")
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("_id", "_hash"), F.lit(CHUNKS)))
    inside = Window.partitionBy("_rank", "_chunk").orderBy("_id", "_hash", "_size")
    rows = (rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_no", F.row_number().over(inside)))
    same = Window.partitionBy("_rank", "_chunk", "_id", "_hash").orderBy("_no")
    rows = rows.withColumn("_copy", F.row_number().over(same))
    before = Window.partitionBy("_rank").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (rows.groupBy("_rank", "_chunk").agg(F.sum("_size").alias("_words"))
              .select("_rank", "_chunk", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base")))
    out = rows.join(chunks, ["_rank", "_chunk"]).select(*_KEY, "_size", (C("_base") + C("_in")).alias("_at"))
    return cut_lineage(out), sources


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The parts of documents that make up each block: ``_block`` and ``_from, _to``, word numbers in the source."""
    spans = F.sequence(F.floor(C("_at") / block), F.floor((C("_at") + C("_size") - 1) / block))
    return (rows.where("_size > 0").withColumn("_block", F.explode(spans))
            .withColumn("_from", F.greatest(C("_at"), C("_block") * block))
            .withColumn("_to", F.least(C("_at") + C("_size"), (C("_block") + 1) * block)))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of ``0 .. size-1`` for each ``key``: a Feistel network, walked until it is back inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, size = index.astype(np.uint64), size.astype(np.uint64)
    open_ = np.ones(len(out), bool)
    while open_.any():
        h, m, k = half[open_], mask[open_], key[open_].astype(np.uint64)
        left, right = out[open_] >> h, out[open_] & m
        for turn in range(4):
            mixed = (right + k + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & m)
        out[open_] = left << h | right
        open_ = out >= size
    return out.astype(np.int64)


def draws(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> DataFrame:
    """``_rank, _shard, _draw, _block, _until``: which block of which source each draw takes, up to word ``_until``."""
    plan = (sources.where("_total > 0").withColumn("_words", F.round("_target").cast("bigint"))
            .withColumn("_blocks", F.ceil(C("_total") / block)).withColumn("_rest", C("_words") % C("_total"))
            .withColumn("_draws", F.floor(C("_words") / C("_total")) * C("_blocks") + F.ceil(C("_rest") / block)))
    shards = max(1, -(-(plan.agg(F.sum("_draws")).first()[0] or 0) // shard))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rank, n in zip(frame["_rank"], frame["_draws"]):
                rng = np.random.default_rng([seed, int(rank)])
                if n >= shards:
                    counts = rng.multinomial(n, np.full(shards, 1 / shards))
                    to = np.flatnonzero(counts)
                    counts = counts[to]
                else:
                    to, counts = np.unique(rng.integers(0, shards, n), return_counts=True)
                yield pd.DataFrame({"_rank": rank, "_shard": to, "_count": counts, "_first": np.cumsum(counts) - counts})

    @F.pandas_udf("bigint")
    def block_of(slot: pd.Series, full: pd.Series, rank: pd.Series, epoch: pd.Series) -> pd.Series:
        out, inside = slot.to_numpy().astype(np.int64).copy(), (slot < full).to_numpy()
        keys = rank.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + epoch.to_numpy().astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)
        out[inside] = permuted(out[inside], full.to_numpy().astype(np.int64)[inside], keys[inside])
        return pd.Series(out)  # a last block that is not full stays the last of its epoch

    counts = plan.select("_rank", "_draws").mapInPandas(spread, "_rank bigint, _shard bigint, _count bigint, _first bigint")
    rows = (counts.repartition("_rank", "_shard").select("_rank", "_shard", F.explode(F.sequence("_first", C("_first") + C("_count") - 1)).alias("_draw"))
            .join(plan.select("_rank", "_blocks", "_total", "_rest", "_draws"), "_rank")
            .withColumn("_slot", C("_draw") % C("_blocks")).withColumn("_epoch", F.floor(C("_draw") / C("_blocks"))))
    rows = rows.withColumn("_block", block_of("_slot", F.floor(C("_total") / block), "_rank", "_epoch"))
    # The last draw of all takes only what its source still lacks.
    short = (C("_rest") > 0) & (C("_draw") == C("_draws") - 1)
    length = F.when(short, C("_rest") - (F.ceil(C("_rest") / block) - 1) * block).otherwise(F.lit(block))
    return rows.select("_rank", "_shard", "_draw", "_epoch", "_block", (C("_block") * block + length).alias("_until"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK,
        shard: int = SHARD, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as pieces of documents, the documents with their sizes, and the sources with their targets.

    A piece is ``_shard, _rank, _draw, _block`` (where it goes), ``_id, _hash, _copy`` (whose words) and ``_first, _n`` (which
    words).  NULL texts have no words; NULL ids and sources are values like any other; repeated rows are documents of
    their own.  The result depends on rows and seed only, not on their order.  An empty table gives empty results.
    """
    rows, sources = placed(docs, doc_id, text, source)
    joined = pieces(rows, block).join(draws(sources, block, shard, seed), ["_rank", "_block"])
    mixed = joined.withColumn("_n", F.least("_to", "_until") - C("_from")).where("_n > 0")
    return mixed.select("_shard", "_draw", "_epoch", "_block", *_KEY, (C("_from") - C("_at")).alias("_first"), "_n"), rows, sources


def mixed_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: ``shard, slot, source, epoch, block, words``, the slots of a shard in pseudorandom order."""
    mixed, rows, sources = mix(docs, doc_id, text, source, **options)
    texts = docs.select(C(doc_id).alias("_id"), common.text_key(text).alias("_hash"), C(text).alias("_text")).dropDuplicates(["_id", "_hash"])
    words = F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    piece = F.struct("_first", "_n")
    cut = (common.join_null_safe(mixed.groupBy("_id", "_hash").agg(F.collect_set(piece).alias("_cuts")), texts, ["_id", "_hash"])
           .withColumn("_words", words).select("_id", "_hash", F.explode(F.transform(
               "_cuts", lambda c: F.struct(c["_first"].alias("_first"), c["_n"].alias("_n"), F.slice("_words", c["_first"] + 1, c["_n"]).alias("_words")))).alias("_p"))
           .select("_id", "_hash", "_p.*"))
    parts = common.join_null_safe(mixed, cut, ["_id", "_hash", "_first", "_n"])
    order = F.struct("_hash", "_id", "_copy", "_first", "_words")
    whole = (parts.groupBy("_shard", "_rank", "_draw", "_epoch", "_block")
             .agg(F.flatten(F.transform(F.sort_array(F.collect_list(order)), lambda p: p["_words"])).alias("words")))
    slot = F.row_number().over(Window.partitionBy("_shard").orderBy(F.xxhash64("_rank", "_draw"), "_rank", "_draw"))
    out = whole.withColumn("slot", slot - 1).join(sources.select("_rank", "_source"), "_rank")
    return out.select(C("_shard").alias("shard"), "slot", C("_source").alias("source"), C("_epoch").alias("epoch"), C("_block").alias("block"), "words")


def taken(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, one row per row of ``docs``: what the mix takes of each."""
    mixed, rows, sources = mix(docs, doc_id, text, source, **options)
    words = mixed.groupBy(*_KEY).agg(F.sum("_n").alias("_taken"))
    out = common.join_null_safe(rows, words, _KEY, "left")
    out = common.lookup(out, sources.select("_rank", "_total", "_target"), ["_rank"], ["_id", "_hash"])
    return out.select(C("_id").alias(doc_id), C("_size").alias("size"), C("_total").alias("source_size"), C("_target").alias("target"),
                      F.coalesce("_taken", F.lit(0).cast("bigint")).alias("taken"))
