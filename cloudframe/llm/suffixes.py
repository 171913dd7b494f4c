"""Repeated strings of ``LENGTH`` bytes by external induced sorting of suffixes.

A suffix is a place in a document.  Of each string of ``LENGTH`` bytes, the place of its least hashed ``GRAM`` bytes is
sampled: equal strings have their sampled place at the same offset.  Only sampled places whose gram occurs twice can
matter, so only around these are bytes sent.  Spark's external sort, which spills and merges on disk, brings the sampled
suffixes into order.  From them the order of all other suffixes is induced, right to left: a tuple (class of the bytes
after it, byte, rank, common prefix with its neighbour) for each place becomes that of the place before, classes split by
byte, and the common prefix of new neighbours is the least of those between them.  Where a suffix shares at least
``LENGTH`` bytes with a neighbour, its string occurs again.  Groups of grams of any size are sorted together: what a task
holds in memory for a large one is a few numbers a suffix, its bytes lie in an unnamed file.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cloudframe.llm import common
from cloudframe.llm.common import C

#: Bytes of a string that counts as repeated, of a gram, and of bodies that are sorted in memory at a time.
LENGTH, GRAM, IN_MEMORY = 400, 16, 1 << 25
_POSITION = np.uint64((1 << 24) - 1)
_PIECE = 1 << 23


def _hashed(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at each place."""
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    h = words[:len(data) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += words[GRAM - 8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours (van Herk 1992): running minima from both ends of blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1:width - 1 + n])


def sampled(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``gram hash, place, first, last``: each sampled place and the run of string starts that it stands for."""
    out = [np.zeros((4, 0), np.int64)]
    for base in range(0, len(data) - length + 1, _PIECE):
        part = data[base:base + _PIECE + length - 1]
        h = _hashed(part)
        keys = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        place = (_least(keys, length - GRAM + 1) & _POSITION).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(place) - 1]))
        out.append(np.stack([h[place[first]].view(np.int64), place[first] + base, first + base, last + base]))
    gram, place, first, last = np.concatenate(out, axis=1)
    return gram, place, first, last


def induced(group: np.ndarray, left: np.ndarray, left_length: np.ndarray, least: np.ndarray, shared: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which starts are repeated: a row per sampled suffix, a column per number of bytes before its place.

    Suffixes come sorted by group and bytes; ``shared`` is the common prefix of each with the one before it, ``left`` the
    bytes before each place, nearest first, ``least`` the first column that belongs to the suffix.
    """
    hit = np.zeros((len(group), int(left_length.max(initial=0)) + 1), bool)
    index, kind, common_ = np.arange(len(group)), group.astype(np.int64), shared.astype(np.int64)
    for o in range(hit.shape[1]):
        with_before = np.concatenate(([False], kind[1:] == kind[:-1]))
        with_after = np.concatenate((with_before[1:], [False]))
        after = np.concatenate((common_[1:], [0]))
        most = np.maximum(np.where(with_before, common_, -1), np.where(with_after, after, -1))
        hit[index[(most >= length - o) & (least[index] <= o)], o] = True
        # Go on with the suffixes that still have a like one and a byte before; classes split by that byte.
        stay = np.flatnonzero((with_before | with_after) & (left_length[index] > o))
        if not len(stay):
            break
        key = kind[stay] * 256 + left[index[stay], o]
        order = np.argsort(key, kind="stable")
        at, key = stay[order], key[order]
        kind = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        now = np.zeros(len(at), np.int64)
        if len(at) > 1:
            now[1:] = common_[at[1:]]
            far = np.flatnonzero((key[1:] == key[:-1]) & (at[1:] != at[:-1] + 1)) + 1
            if len(far):
                ends = np.stack([at[far - 1] + 1, at[far] + 1], axis=1).ravel()
                now[far] = np.minimum.reduceat(np.append(common_, 0), ends)[::2]
        index, common_ = index[at], now
    return hit


def _rows_of(bodies: list[bytes], width: int, on_disk: bool) -> np.ndarray:
    """Byte strings as the rows of a matrix, filled up with zeros; in an unnamed file if they are many."""
    if on_disk:
        out = np.memmap(tempfile.TemporaryFile(), np.uint8, "w+", shape=(len(bodies), max(1, width)))
    else:
        out = np.zeros((len(bodies), max(1, width)), np.uint8)
    for i, body in enumerate(bodies):
        out[i, :len(body)] = np.frombuffer(body, np.uint8)
    return out


def _sorted_part(grams: list[int], left: list[bytes], right: list[bytes], least: list[int], count: list[int], length: int) -> list[tuple[list[int], list[int]]]:
    """Runs of repeated starts of each suffix of some whole groups, in bytes before the place, from far to near."""
    on_disk = sum(map(len, left)) + sum(map(len, right)) > 2 * IN_MEMORY
    left_length = np.array([len(x) for x in left])
    reversed_ = _rows_of([x[::-1] for x in left], int(left_length.max(initial=0)), on_disk)
    ahead = _rows_of(right, length, on_disk)
    right_length = np.array([len(x) for x in right])
    shared = np.zeros(len(left), np.int64)
    for i in range(1, len(left), 1 << 14):
        j = min(i + (1 << 14), len(left))
        apart = ahead[i:j] != ahead[i - 1:j - 1]
        first = np.where(apart.any(axis=1), apart.argmax(axis=1), length)
        shared[i:j] = np.minimum(first, np.minimum(right_length[i:j], right_length[i - 1:j - 1]))
    group = np.concatenate(([0], np.cumsum(np.diff(np.array(grams)) != 0)))
    hit = induced(group, reversed_, left_length, np.array(least), shared, length)
    out = []
    for i, times in enumerate(count):
        if times > 1:  # the whole body occurs again
            out.append(([int(left_length[i])], [int(least[i])]))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[i, :left_length[i] + 1].astype(np.int8), [0]))))
        out.append(((edge[1::2] - 1)[::-1].tolist(), edge[::2][::-1].tolist()))
    return out


def _packed(place: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """A sampled place and the run of string starts that it stands for (both less than ``length`` before it) as one number."""
    return (place * length + (place - first)) * length + (place - last)


def _unpacked(packed: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``place, first, last``."""
    place = packed // (length * length)
    return place, place - packed // length % length, place - packed % length


def _samples(docs: DataFrame, id_type: str, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, places = [], [], []
            for i, text in enumerate(batch.column(2)):
                data = np.frombuffer(text.as_py(), np.uint8)
                if len(data) >= length:
                    gram, *place = sampled(data, length)
                    rows.append(np.full(len(gram), i))
                    grams.append(gram)
                    places.append(_packed(*place, length))
            if rows:
                keys = batch.select(["_id", "_hash"]).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(np.concatenate(grams)), pa.array(np.concatenate(places))], ["_id", "_hash", "_gram", "_place"])

    return docs.mapInArrow(run, f"_id {id_type}, _hash bigint, _gram bigint, _place bigint")


def _around(data: bytes, wanted: list[int], length: int) -> Iterator[tuple[bytes, int, int, int, int, int]]:
    """``name, gram, wanted, place, first, last`` of the wanted sampled places; equal bodies around equal places have equal names."""
    wanted = np.sort(np.array(wanted, np.int64))
    place, first, last = _unpacked(wanted, length)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), GRAM)[place]).ravel()
    gram = _hashed(grams)[::GRAM].view(np.int64) if len(grams) else wanted
    for g, w, p, f, l in zip(*(x.tolist() for x in (gram, wanted, place, first, last))):
        salt = (p - f).to_bytes(8, "little") + (g & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
        yield hashlib.blake2b(data[f:l + length], digest_size=16, salt=salt).digest(), g, w, p, f, l


def _occurrences(rows: DataFrame, id_type: str, length: int) -> DataFrame:
    """Where each body occurs: ``_id, _hash, _body, _place``, from documents with the places whose gram occurs twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, name, w) for i, (text, places) in enumerate(zip(batch.column(2), batch.column(3)))
                     for name, _, w, _, _, _ in _around(text.as_py(), places.as_py(), length)]
            if found:
                picked, names, starts = zip(*found)
                keys = batch.select(["_id", "_hash"]).take(pa.array(picked))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(names, pa.binary()), pa.array(starts, pa.int64())], ["_id", "_hash", "_body", "_place"])

    return rows.mapInArrow(run, f"_id {id_type}, _hash bigint, _body binary, _place bigint")


def _bodies(rows: DataFrame, length: int) -> DataFrame:
    """The bodies themselves, from documents with the places and names of those that they stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, chosen in zip(batch.column(2), batch.column(3)):
                data, count = text.as_py(), {c["_body"]: c["_count"] for c in chosen.as_py()}
                out += [(name, g, data[f:p], data[p:l + length], p - l, count[name])
                        for name, g, _, p, f, l in _around(data, [c["_place"] for c in chosen.as_py()], length) if name in count]
            if out:
                kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["_body", "_gram", "_left", "_right", "_least", "_count"])

    return rows.mapInArrow(run, "_body binary, _gram bigint, _left binary, _right binary, _least bigint, _count bigint")


def _repeated(bodies: DataFrame, length: int) -> DataFrame:
    """``_body, _runs``: the repeated starts of each body, in bytes before its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []

        def done() -> pa.RecordBatch:
            columns = list(zip(*held))
            runs = _sorted_part(*columns[1:], length)
            kept = [(b, [{"_far": f, "_near": n} for f, n in zip(*r)]) for b, r in zip(columns[0], runs) if r[0]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in kept], pa.binary()),
                                               pa.array([r for _, r in kept], pa.list_(pa.struct([("_far", pa.int64()), ("_near", pa.int64())])))], ["_body", "_runs"])

        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                body, gram, left, right, least, count = row
                if held and held[-1][0] == body:
                    continue  # a repeated row has sent it again
                if size > IN_MEMORY and held[-1][1] != gram:
                    yield done()
                    size = 0
                held.append([body, gram, left, right, least, count])
                size += len(left) + len(right)
        if held:
            yield done()

    ordered = bodies.repartition("_gram").sortWithinPartitions("_gram", "_right", "_left", "_least")
    return ordered.mapInArrow(run, "_body binary, _runs array<struct<_far:bigint,_near:bigint>>")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: ``_id, _hash, n_bytes, n_removed, n_spans, kept`` (the bytes that are left).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same document or another.
    Strings are judged on the input and never cross documents.  NULL texts count as empty; repeated rows are copies of
    each other, so all their strings of that length are repeated.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(C(doc_id).alias("_id"), common.text_key(text).alias("_hash"), F.coalesce(C(text), F.lit("")).cast("binary").alias("_text"))
    # Samples and occurrences of bodies are read three times each, so they are written instead of found again.
    samples, folder = common.written(_samples(rows, id_type, length), "repeats-samples")
    twice = samples.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    known = common.lookup(samples, twice, ["_gram"], ["_id", "_hash", "_place"])
    places = known.groupBy("_id", "_hash").agg(F.collect_set("_place").alias("_places"))
    where = common.written(_occurrences(common.join_null_safe(rows, places, ["_id", "_hash"]).select("_id", "_hash", "_text", "_places"), id_type, length), "repeats-bodies")[0]
    common.removed(docs.sparkSession, folder)
    # Each body is sent once, by the first of the documents that have it.
    first = where.groupBy("_body").agg(F.count(F.lit(1)).alias("_count"), F.min(F.struct("_id", "_hash", "_place")).alias("_f"))
    chosen = (first.groupBy(C("_f._id").alias("_id"), C("_f._hash").alias("_hash"))
              .agg(F.collect_list(F.struct("_body", "_count", C("_f._place").alias("_place"))).alias("_chosen")))
    bodies = _bodies(common.join_null_safe(rows, chosen, ["_id", "_hash"]).select("_id", "_hash", "_text", "_chosen"), length)
    runs = _repeated(bodies, length)
    marked = (common.lookup(where, runs, ["_body"], ["_id", "_hash", "_place"]).select("_id", "_hash", "_place", F.explode("_runs").alias("_r"))
              .withColumn("_place", F.expr(f"_place div {length * length}"))
              .groupBy("_id", "_hash").agg(F.collect_set(F.struct((C("_place") - C("_r._far")).alias("_from"), (C("_place") - C("_r._near") + length).alias("_to"))).alias("_spans")))
    joined = common.join_null_safe(rows, marked, ["_id", "_hash"], "left").select("_id", "_hash", "_text", F.sort_array("_spans").alias("_spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, kept = [], [], []
            for data, spans in zip(batch.column(2), batch.column(3)):
                data, out, at, merged = data.as_py(), [], 0, 0
                for span in spans.as_py() or ():
                    if span["_from"] > at or not merged:
                        out.append(data[at:span["_from"]])
                        merged += 1
                    at = max(at, span["_to"])
                out.append(data[at:])
                kept.append(b"".join(out))
                n_spans.append(merged)
                removed.append(len(data) - len(kept[-1]))
            sizes = [len(k) + r for k, r in zip(kept, removed)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()),
                                              pa.array(kept, pa.binary())], ["_id", "_hash", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, f"_id {id_type}, _hash bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
