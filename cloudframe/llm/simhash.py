"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a word in common that is within half the radius of both.  So every
fingerprint emits all its variants within half the radius, equal variants meet, and what met is verified.  Of a 64-bit
fingerprint and radius 4 that is 2,081 variants.  Variants are dealt by a linear code: the bucket of a variant is the
bucket of the fingerprint XOR that of the flipped bits.  A fingerprint is sent once to each bucket that some of its
variants fall into, and the variants of the bucket are written out only there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.llm import common
from cloudframe.llm.common import C
from cloudframe.llm.graph import components

BITS = 64
#: Variants that one task sorts at a time; the number of buckets follows from it.
VARIANTS_PER_BUCKET = 1 << 24
MIN_BUCKET_BITS = 6
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of the word shingles of a UTF-8 text, as a signed 64-bit number; 0 without words."""
    words = (text or b"").lower().split()  # bytes.lower() and bytes.split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    spans = zip(starts[:len(last)].tolist(), last.tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(last))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i:i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``_id, _hash, _fp`` for every row: id, hash of the text (to tell apart repeated ids), fingerprint."""
    rows = docs.select(C(doc_id).alias("_id"), common.text_key(text).alias("_hash"), C(text).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.int64())], ["_id", "_hash", "_fp"])

    return rows.mapInArrow(run, f"_id {docs.schema[doc_id].dataType.simpleString()}, _hash bigint, _fp bigint")


def _errors(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)], np.uint64)


def _code(values: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Bucket of each word: XOR of the columns of its set bits."""
    out = np.zeros(len(values), np.int64)
    for byte in range(8):
        table = np.zeros(256, np.int64)
        for bit in range(8):
            table[1 << bit:2 << bit] = table[:1 << bit] ^ columns[8 * byte + bit]
        out ^= table[((values >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)]
    return out


def _met(fps: np.ndarray, bucket: int, columns: np.ndarray, radius: int) -> np.ndarray:
    """Links (two columns) between the fingerprints that have a variant of this bucket in common."""
    errors = _errors(radius // 2)
    by_code = np.argsort(codes := _code(errors, columns), kind="stable")
    codes, errors = codes[by_code], errors[by_code]
    fps = np.unique(fps)
    own = _code(fps, columns)
    variants, owners = [], []
    for code in np.unique(own):
        some = errors[np.searchsorted(codes, code ^ bucket):np.searchsorted(codes, code ^ bucket, "right")]
        mine = fps[own == code]
        variants.append((mine[:, None] ^ some[None, :]).ravel())
        owners.append(np.repeat(mine, len(some)))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(variants)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return np.zeros((0, 2), np.uint64)
    maybe = np.zeros(1 << 16, bool)
    maybe[(shared & np.uint64(0xFFFF)).astype(np.int64)] = True
    picked = maybe[(variants & np.uint64(0xFFFF)).astype(np.int64)]
    variants, owners = variants[picked], owners[picked]
    place = np.minimum(np.searchsorted(shared, variants), len(shared) - 1)
    hit = shared[place] == variants
    place, owners = place[hit], owners[hit]
    order = np.lexsort((owners, place))
    place, owners = place[order], owners[order]
    # All that met on one variant lie within the radius of each other, so the smallest stands for the whole meeting.
    first = np.searchsorted(place, place)
    pairs = np.unique(np.stack([owners, owners[first]], axis=1)[owners != owners[first]], axis=0)
    apart = pairs[:, 0] ^ pairs[:, 1]
    return pairs[np.bitwise_count(apart) <= radius]


def links(distinct: DataFrame, radius: int = 4, bucket_bits: int | None = None) -> DataFrame:
    """``a, b``: links between different fingerprints (column ``_fp``, each once) that connect all that are within ``radius``."""
    if bucket_bits is None:
        variants = distinct.count() * len(_errors(radius // 2))
        bucket_bits = max(MIN_BUCKET_BITS, math.ceil(math.log2(max(1, variants / VARIANTS_PER_BUCKET))))
    columns = np.random.default_rng(20240229).integers(0, 1 << bucket_bits, BITS)
    reached = np.unique(_code(_errors(radius // 2), columns))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            own = _code(fps, columns)
            if len(reached) == 1 << bucket_bits:
                buckets, blobs = np.arange(1 << bucket_bits), [fps.tobytes()] * (1 << bucket_bits)
            else:
                to = (own[:, None] ^ reached[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                buckets, starts = np.unique(to[order], return_index=True)
                blobs = [x.tobytes() for x in np.split(fps[order // len(reached)], starts[1:])]
            if len(fps):
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "fps"])

    def meet(table: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(x.as_py() for x in table.column("fps")), np.uint64)
        pairs = _met(fps, table.column("bucket")[0].as_py(), columns, radius).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return distinct.select("_fp").mapInArrow(deal, "bucket bigint, fps binary").groupBy("bucket").applyInArrow(meet, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``_id, _hash, _fp, component_id``, the smallest id that can be reached over links.

    Fingerprints link at ``radius`` or fewer differing bits.  NULL, empty and blank texts have fingerprint 0, which links
    like any other.  Repeated rows share everything.  A component without any id has a NULL ``component_id``.
    """
    fps = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    distinct = cut_lineage(fps.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots, C("_fp") == C("node"), "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("root"))
    whole = common.summary_by_group(rooted, ["root"], ["_fp"], {"component_id": ("min", "_least")}).select("_fp", "component_id")
    return common.lookup(fps, whole, ["_fp"], ["_id", "_hash"])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each group of near-duplicates the one with the smallest id."""
    groups = near_groups(docs, doc_id, text, shingle, radius)
    best = groups.where(C("_id").eqNullSafe(C("component_id"))).groupBy("_id").agg(F.min("_hash").alias("_hash"))
    return common.rows_of(docs, best, doc_id, text, once=True)
