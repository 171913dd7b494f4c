"""Benchmark decontamination by greedy string tiling (Wise 1993) with running Karp-Rabin hashes.

Seeds are windows of ``SEED`` words that a document shares with a benchmark item.  Documents and items that share seeds
are joined; each such pair is tiled: the longest matches of words that are not yet marked are marked first, then shorter
ones, down to the seed length, so that passages are found whatever their order.  A document is contaminated by an item
if the tiles cover at least ``COVERAGE`` of the item's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.llm import common
from cloudframe.llm.common import C

#: Words of a seed and of the shortest tile; share of an item's words that tiles must cover.
SEED, COVERAGE = 5, 0.5
#: Bits of the filter that tells which windows may be in the benchmark: 8 MB, whatever the size of the benchmark.  A
#: window that passes by chance costs time only, since seeds are joined by their words afterwards.
FILTER_BITS = 1 << 26
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"n": 0}


def normal(text: str | None) -> str:
    """Words of a text: runs of letters, digits and underscores, lower-cased, one blank between."""
    return " ".join(re.findall(r"\w+", (text or "").lower()))


def _raised(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        _powers.update(n=size, up=_raised(_BASE, size), down=_raised(_BACK, size))
    return _powers["up"], _powers["down"]


def windows(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of ``codes[start:end]``, all from one running sum."""
    up, down = _powers_to(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:len(codes)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _seeds(words: str, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the seeds of normalised text and where its words start and end, in bytes."""
    codes = np.frombuffer(words.encode(), np.uint8)
    blanks = np.flatnonzero(codes == 32)
    starts, ends = np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(codes)]))
    if not len(codes) or len(starts) < seed:
        return np.zeros(0, np.uint64), starts, ends
    return windows(codes, starts[:len(starts) - seed + 1], ends[seed - 1:]), starts, ends


def tiles(item: list[str], runs: list[list[str]], shortest: int = SEED) -> list[tuple[int, int]]:
    """Greedy string tiling: ``(place in the item, length)`` of each tile; ``runs`` are parts of the document."""
    ids: dict[str, int] = {}
    p = np.array([ids.setdefault(w, len(ids) + 1) for w in item], np.int64)
    t = np.concatenate([np.array([0] + [ids.get(w, 0) for w in run], np.int64) for run in runs] + [np.zeros(1, np.int64)])
    marked_p, marked_t, out = np.zeros(len(p), bool), t == 0, []

    def free(codes: np.ndarray, marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.concatenate(([0], np.cumsum(marked)))
        at = np.flatnonzero(sums[length:] == sums[:len(sums) - length])
        return at, windows(codes, at, at + length)

    length = max(shortest, len(p))
    while len(p) >= shortest:
        if length <= min(len(p), len(t)):
            while True:
                at_p, hash_p = free(p, marked_p, length)
                at_t, hash_t = free(t, marked_t, length)
                order = np.argsort(hash_t, kind="stable")
                at_t, hash_t = at_t[order], hash_t[order]
                low, high = np.searchsorted(hash_t, hash_p), np.searchsorted(hash_t, hash_p, "right")
                found = []
                for i, a, b in zip(at_p, low, high):
                    here, n = at_t[a:b], 0
                    best = here
                    while len(here):  # word by word: this also drops windows that only share the hash
                        if i + n == len(p) or marked_p[i + n]:
                            best = here
                            break
                        inside = here[here + n < len(t)]
                        more = inside[(t[inside + n] == p[i + n]) & ~marked_t[inside + n]]
                        if not len(more):
                            best = here
                            break
                        here, n = more, n + 1
                    if n >= length:
                        found.append((-n, int(i), int(best.min())))
                found.sort()
                for n, i, j in found:
                    if not marked_p[i:i - n].any() and not marked_t[j:j - n].any():
                        marked_p[i:i - n] = marked_t[j:j - n] = True
                        out.append((i, -n))
                if not found:
                    break
        if length == shortest or marked_p.all():
            break
        length = max(shortest, length // 2)
    return out


def _item_seeds(items: DataFrame, seed: int) -> DataFrame:
    """``_item, _length, _seed, _times``: the seeds of the benchmark items and how often an item has each."""
    words = F.split("_words", " ")
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - seed), lambda i: F.array_join(F.slice(words, i + 1, F.lit(seed)), " "))
    return (items.where(F.size(words) >= seed).select("_item", F.size(words).alias("_length"), F.explode(grams).alias("_seed"))
            .groupBy("_item", "_length", "_seed").agg(F.count(F.lit(1)).alias("_times")))


def _filter(items: DataFrame, seed: int, bits: int) -> np.ndarray:
    """One bit per possible hash of a seed; collected as at most ``bits / 64`` words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch.column(0):
                places = np.unique(_seeds(words.as_py(), seed)[0] % np.uint64(bits))
                yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)),
                                                  pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], ["word", "bits"])

    rows = items.select("_words").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _runs(docs: DataFrame, doc_id: str, text: str, items: DataFrame, seed: int, bits: int) -> DataFrame:
    """``_id, _hash, _runs`` of the documents with windows that pass the filter: the runs of words that such windows cover."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_filter(items, seed, bits))
    rows = docs.select(C(doc_id).alias("_id"), common.text_key(text).alias("_hash"), C(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            picked, found = [], []
            for n, text_ in enumerate(batch.column(2)):
                words = normal(text_.as_py())
                hashes, starts, ends = _seeds(words, seed)
                place = hashes % np.uint64(bits)
                hits = np.flatnonzero((table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                if len(hits):
                    cut = np.flatnonzero(np.diff(hits) > seed) + 1  # windows that touch or overlap make one run
                    first, last = hits[np.concatenate(([0], cut))], hits[np.concatenate((cut - 1, [len(hits) - 1]))] + seed - 1
                    raw = words.encode()
                    picked.append(n)
                    found.append([raw[starts[a]:ends[b]].decode() for a, b in zip(first, last)])
            if picked:
                keep = batch.take(pa.array(picked))
                yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1), pa.array(found, pa.list_(pa.string()))], ["_id", "_hash", "_runs"])

    return rows.mapInArrow(run, f"_id {docs.schema[doc_id].dataType.simpleString()}, _hash bigint, _runs array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", seed: int = SEED, coverage: float = COVERAGE, bits: int = FILTER_BITS) -> DataFrame:
    """One row per contaminated row of ``docs`` and item: ``_id, _hash, _item, item_words, matched_words, tiles, coverage``.

    Items of fewer than ``seed`` words and NULL or empty texts match nothing; repeated rows are reported as often as they
    occur, repeated items once each.  Documents with the same runs of words are tiled once for all.
    """
    kind = benchmark.schema[item_id].dataType.simpleString()

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal(t.as_py()) for t in batch.column(1)], pa.string())], ["_item", "_words"])

    items = benchmark.select(C(item_id).alias("_item"), C(item_text).alias("_words")).mapInArrow(words_of, f"_item {kind}, _words string")
    items = cut_lineage(items.distinct())
    runs = _runs(docs, doc_id, text, items, seed, bits)
    runs = cut_lineage(runs.withColumn("_key", F.sha2(F.array_join("_runs", "\n"), 256)))
    distinct = cut_lineage(runs.groupBy("_key").agg(F.first("_runs").alias("_runs")))
    words = F.split("_run", " ")
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - seed), lambda i: F.array_join(F.slice(words, i + 1, F.lit(seed)), " "))
    seeds = distinct.select("_key", F.explode("_runs").alias("_run")).select("_key", F.explode(grams).alias("_seed")).distinct()
    # No tiling covers more words than the shared windows of the item have together.
    pairs = (seeds.join(_item_seeds(items, seed), "_seed").groupBy("_key", "_item", "_length").agg(F.sum("_times").alias("_windows"))
             .where(C("_windows") * seed >= C("_length") * coverage))
    pairs = pairs.join(distinct, "_key").join(items.where("_words <> ''").withColumnRenamed("_item", "_same"), C("_item").eqNullSafe(C("_same"))).drop("_same")

    def tile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [tiles(w.split(" "), [r.split(" ") for r in runs_], seed) for w, runs_ in zip(frame["_words"], frame["_runs"])]
            frame = frame[["_key", "_item"]].assign(item_words=[w.count(" ") + 1 for w in frame["_words"]],
                                                    matched_words=[sum(n for _, n in f) for f in found], tiles=[len(f) for f in found])
            yield frame

    tiled = pairs.select("_key", "_item", "_words", "_runs").mapInPandas(tile, f"_key string, _item {kind}, item_words bigint, matched_words bigint, tiles bigint")
    tiled = tiled.withColumn("coverage", C("matched_words") / C("item_words")).where(C("coverage") >= coverage)
    matched = tiled.groupBy("_key").agg(F.collect_list(F.struct("_item", "item_words", "matched_words", "tiles", "coverage")).alias("_items"))
    return common.lookup(runs.drop("_runs"), matched, ["_key"], ["_id", "_hash"]).select("_id", "_hash", F.explode("_items").alias("_m")).select("_id", "_hash", "_m.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no item contaminates."""
    found = leaks(docs, benchmark, doc_id, text, **options).select("_id", "_hash").distinct()
    return common.rows_of(docs, found, doc_id, text, "left_anti")
