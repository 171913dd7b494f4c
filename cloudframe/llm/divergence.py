"""How the words of each source diverge from those of the other sources of its language.

Late string materialisation: words are counted by 64-bit digests, so the counting shuffles carry fixed-width rows only.
Beside the counts, one aggregation keeps the smallest and the largest string of each digest.  Where the two differ, words
collide, and the rows of that digest (and no others) are counted by digest and string.  Strings come back at the very end,
for the words that are reported.

Sums over all kept words of a pair of sources need no row per word and pair: a word that one source has and the other
lacks adds what its count alone determines, so such words are added up by count, and only words that both sources have are
joined.  Shares are whole billionths, so every figure is exact.

Defined cases: a row is a document (repeated rows are documents of their own); NULL text, language and source are ``''``;
a group without words and an empty table are no error (values 0, and no rows); other columns are ignored, whatever they
are called; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.llm import common
from cloudframe.llm.common import C
from cloudframe.skew import MOST_BROADCAST

BILLION = 1_000_000_000
#: Sums of words that a task holds before it hands them on, bytes of text that it cuts into words at a time (a longer text
#: is cut as one), pairs of sources sharing a word that it works out at a time,
#: and rows that it hands on at a time.
HELD, _BYTES, _PAIRS, _ROWS = 800_000, 1 << 22, 1 << 20, 1 << 14
# A-Z in lower case, a-z and all bytes of longer characters stay, everything else parts words.
_LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
_COUNTED = "lang string, source string, term string, docs bigint, n bigint, fresh boolean"


def _sums_of_words(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """``group, term, docs, n`` over the words of some texts."""
    texts = texts.cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    mapped = _LETTERS[raw]
    letter = np.append(mapped != 0, False)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    cuts = offsets[:-1][letter[offsets[:-1]]]  # a word ends with its text
    first[cuts] = True
    starts = np.flatnonzero(first)
    letters = np.concatenate(([0], np.cumsum(letter, dtype=np.int32)))
    ends = np.append(letters[starts[1:]], letters[-1])
    buffers = [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(mapped[letter[:-1]])]
    words = pa.Array.from_buffers(pa.string(), len(starts), buffers).dictionary_encode()
    number, doc = max(1, len(words.dictionary)), np.searchsorted(offsets, starts, "right") - 1
    by_doc, n = np.unique(doc * number + words.indices.to_numpy(), return_counts=True)
    keys = group[by_doc // number] * number + by_doc % number
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
    docs = np.diff(np.append(at, len(keys)))
    n = np.add.reduceat(n, at) if len(keys) else n
    return keys[at] // number, words.dictionary.take(pa.array(keys[at] % number)), docs, n


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, docs, n, fresh``: documents with a word and its occurrences, summed up per task.

    Sums of the same word may lie in several rows, of which one at least is ``fresh`` in each task; every group has a row
    without a word.
    """
    rows = docs.select(F.coalesce(C(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(C(source).cast("string"), F.lit("")).alias("source"),
                       F.coalesce(C(text), F.lit("")).cast("binary").alias("text"))

    def merged(held: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(held).group_by(["group", "term"]).aggregate([("docs", "sum"), ("n", "sum")])
        return summed.rename_columns({"docs_sum": "docs", "n_sum": "n"}).select(["group", "term", "docs", "n"])

    def given(table: pa.Table, names: list[list[str]]) -> Iterator[pa.RecordBatch]:
        terms = table["term"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        fresh = np.zeros(len(table), bool)
        fresh[np.unique(terms, return_index=True)[1]] = True
        lang, source = (pa.array(n, pa.string()) for n in names)
        for part in table.append_column("fresh", pa.array(fresh)).to_batches(_ROWS):
            columns = [lang.take(part["group"]), source.take(part["group"]), part["term"], part["docs"], part["n"], part["fresh"]]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "docs", "n", "fresh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, numbers, names = 0, {}, [[], []]  # the groups of this task
        for batch in batches:
            lengths = pc.binary_length(batch.column(2)).to_numpy()
            part = np.cumsum(lengths, dtype=np.int64) // _BYTES
            for some in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
                if not len(some):
                    continue
                piece = batch.slice(int(some[0]), len(some))
                group = np.empty(len(some), np.int64)
                for i, name in enumerate(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist())):
                    if name not in numbers:
                        numbers[name] = len(numbers)
                        names[0].append(name[0])
                        names[1].append(name[1])
                    group[i] = numbers[name]
                groups, terms, in_docs, n = _sums_of_words(piece.column(2), group)
                here = np.unique(group)  # the rows without a word
                none = np.zeros(len(here), np.int64)
                columns = [pa.array(np.append(groups, here)), pa.concat_arrays([terms, pa.nulls(len(here), pa.string())]),
                           pa.array(np.append(in_docs, none)), pa.array(np.append(n, none))]
                held.append(pa.table(columns, ["group", "term", "docs", "n"]))
                rows += len(held[-1])
                if rows > HELD:
                    held = [merged(held)]
                    rows = len(held[0])
                    if 2 * rows > HELD:
                        yield from given(held[0], names)
                        held, rows = [], 0
        if held:
            yield from given(merged(held), names)

    return rows.mapInArrow(run, _COUNTED)


def _digest(term: Column) -> Column:
    return F.xxhash64(term)


def kept_counts(docs: DataFrame, least: int = 3, text: str = "text", lang: str = "lang", source: str = "source",
                digest: Callable[[Column], Column] = _digest) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of the words that at least ``least`` documents of their language have, by digest.

    Returns ``(groups, counts, strings)``: all ``lang, source``; ``lang, source, _key, _split, n, total, first`` where
    ``total`` is the count in the language, ``first`` marks one row of each word of a language and ``_split`` is the word
    itself for digests that stand for several; ``_key, _low`` with the word of every other digest.
    """
    counted = word_counts(docs, text, lang, source)
    rows, _ = common.written(counted.withColumn("_key", F.when(C("term").isNotNull(), digest(C("term")))), "divergence-words")
    groups = rows.where(C("term").isNull()).select("lang", "source").distinct()
    words = rows.where(C("term").isNotNull())
    # Tasks have summed up already: the few rows of a word go straight to where it is summed up for good.
    each = words.where("fresh").select("_key", "term").repartition("_key").distinct()
    strings, _ = common.written(each.groupBy("_key").agg(F.min("term").alias("_low"), F.max("term").alias("_high")), "divergence-strings")
    collided = strings.where(C("_low") != C("_high")).select("_key", F.lit(True).alias("_several"))
    number = collided.count()
    if number:
        # With 64 bits there are none below thousands of millions of words.
        collided = F.broadcast(collided) if number <= MOST_BROADCAST else collided
        words = words.join(collided, "_key", "left").withColumn("_split", F.when(C("_several"), C("term")))
    else:
        words = words.withColumn("_split", F.lit(None).cast("string"))
    summed = (words.select("lang", "source", "_key", "_split", "n", "docs").repartition("lang", "_key")
              .groupBy("lang", "source", "_key", "_split").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    order = Window.partitionBy("lang", "_key", "_split").orderBy("source")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = (summed.withColumns({"total": F.sum("n").over(whole), "_docs": F.sum("docs").over(whole), "first": F.row_number().over(order) == 1})
              .where(C("_docs") >= least).drop("docs", "_docs"))
    return groups, common.written(summed, "divergence-counts")[0], strings.select("_key", "_low")


def _share(count: str, whole: str) -> Column:
    """``1 + floor(10**9 (count + 1) / whole)`` in whole numbers, with wider ones where 64 bits do not hold the product."""
    wide = f"(cast({BILLION} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({whole} as decimal(20,0))"
    return F.expr(f"1 + if({count} < 9000000000, ({BILLION}L * ({count} + 1L)) div {whole}, {wide})")


def _value(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def audit(docs: DataFrame, top: int = 200, least: int = 3, text: str = "text", lang: str = "lang", source: str = "source",
          digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from the others of its language, and by which words.

    Part ``pair`` has every other source, part ``term`` the ``top`` words that the source has more of than its language.
    """
    groups, counts, strings = kept_counts(docs, least, text, lang, source, digest)
    langs = counts.groupBy("lang").agg(F.sum(C("first").cast("bigint")).alias("_v"), F.sum("n").alias("_n"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    groups = cut_lineage(groups.join(sizes, ["lang", "source"], "left").join(langs.withColumnRenamed("_n", "_lang_n"), "lang", "left")
                         .select("lang", "source", (F.coalesce("_n", F.lit(0)) + F.coalesce("_v", F.lit(0))).alias("_whole"), "_lang_n",
                                 F.coalesce("_v", F.lit(0)).alias("_v")))
    out = _pairs(groups, counts).unionByName(_terms(groups, counts, strings, top))
    return out.select("lang", "source", "part", "item", "value", C("rank").cast("int").alias("rank"))


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    # The rows of the result: each source with each other of its language.
    one = groups.select("lang", "source", C("_whole").alias("_a"), "_v")
    pairs = one.join(groups.select("lang", C("source").alias("item"), C("_whole").alias("_b")), "lang").where(C("source") != C("item"))
    none = lambda p, q: F.when(C("_v") > 0, _value(p, q)).otherwise(F.lit(0))
    pairs = pairs.withColumns({"_p0": F.when(C("_v") > 0, _share("0L", "_a")), "_q0": F.when(C("_v") > 0, _share("0L", "_b"))})
    base = pairs.select("lang", "source", "item", (C("_v") * none("_p0", "_q0")).alias("value"))
    # Words of one side, as if the other side had none of them: by count, not by word.
    known = pairs.where(C("_v") > 0)
    by_count = counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("_m"))
    mine = known.join(by_count, ["lang", "source"]).withColumn("_p", _share("n", "_a"))
    mine = mine.select("lang", "source", "item", (C("_m") * (_value("_p", "_q0") - _value("_p0", "_q0"))).alias("value"))
    theirs = known.join(by_count.withColumnRenamed("source", "item"), ["lang", "item"]).withColumn("_q", _share("n", "_b"))
    theirs = theirs.select("lang", "source", "item", (C("_m") * (_value("_p0", "_q") - _value("_p0", "_q0"))).alias("value"))
    # Words that both have: what the three sums above counted for them is taken back.
    shares = counts.join(groups.select("lang", "source", "_whole"), ["lang", "source"]).select(
        "lang", "_key", "_split", "source", _share("n", "_whole").alias("_p"), _share("0L", "_whole").alias("_p0"))
    shares = shares.repartition("lang", "_key").sortWithinPartitions("lang", "_key", "_split")
    both = shares.mapInArrow(_shared, "lang string, source string, item string, value bigint")
    parts = base
    for part in (mine, theirs, both):
        parts = parts.unionByName(part.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of each pair of sources for the words that both have; rows come word by word."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        starts = _starts(table)
        # The last word may go on in the next batch.
        held = table.slice(int(starts[-1]))
        yield from _corrections(table.slice(0, int(starts[-1])), starts[:-1])
    if held is not None:
        yield from _corrections(held, np.zeros(1, np.int64))


def _starts(table: pa.Table) -> np.ndarray:
    """Rows at which another word begins."""
    codes = [pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode").indices.to_numpy() for c in ("lang", "_split")]
    changed = np.ones(len(table), bool)
    changed[1:] = (np.diff(table["_key"].to_numpy()) != 0) | (np.diff(codes[0]) != 0) | (np.diff(codes[1]) != 0)
    return np.flatnonzero(changed)


def _corrections(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(table):
        return
    names = pa.StructArray.from_arrays([table["lang"].combine_chunks(), table["source"].combine_chunks()], ["lang", "source"])
    lang, source = (pc.dictionary_encode(names.field(i)) for i in range(2))
    code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    groups, group = np.unique(code, return_inverse=True)
    p, p0 = table["_p"].to_numpy(), table["_p0"].to_numpy()
    sizes = np.diff(np.append(starts, len(table)))
    width = np.repeat(sizes, sizes)  # of the word of each row
    begin = np.repeat(starts, sizes)
    upto = np.cumsum(width)
    value = lambda a, b: (a - b) * (a - b) // b
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    while low < len(table):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + _PAIRS)))
        left = np.repeat(np.arange(low, high), width[low:high])
        right = np.arange(len(left)) - np.repeat(upto[low:high] - width[low:high] - (upto[low - 1] if low else 0), width[low:high])
        right += np.repeat(begin[low:high], width[low:high])
        left, right = left[left != right], right[left != right]
        change = value(p[left], p[right]) - value(p[left], p0[right]) - value(p0[left], p[right]) + value(p0[left], p0[right])
        found.append(_summed(group[left] * len(groups) + group[right], change))
        low = high
    pair, change = _summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    one, other = groups[pair // len(groups)], groups[pair % len(groups)]
    pick = lambda values, which: values.dictionary.take(pa.array(which))
    yield pa.RecordBatch.from_arrays([pick(lang, one // len(source.dictionary)), pick(source, one % len(source.dictionary)),
                                      pick(source, other % len(source.dictionary)), pa.array(change, pa.int64())], ["lang", "source", "item", "value"])


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the whole sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[starts], np.add.reduceat(values, starts)


def _terms(groups: DataFrame, counts: DataFrame, strings: DataFrame, top: int) -> DataFrame:
    shares = (counts.join(groups, ["lang", "source"]).withColumn("_lang_whole", C("_lang_n") + C("_v"))
              .withColumns({"_p": _share("n", "_whole"), "_q": _share("total", "_lang_whole")}).where(C("_p") > C("_q"))
              .select("lang", "source", "_key", "_split", _value("_p", "_q").alias("value")))
    # The value at the last rank needs no strings; only words at or above it get theirs, to break ties.
    group = Window.partitionBy("lang", "source")
    best = shares.select("lang", "source", "value").withColumn("_no", F.row_number().over(group.orderBy(F.desc("value")))).where(C("_no") <= top)
    least = best.groupBy("lang", "source").agg(F.min("value").alias("_least"))
    near = shares.join(least, ["lang", "source"]).where(C("value") >= C("_least")).drop("_least")
    near, _ = common.written(near, "divergence-near")  # its size is known now
    named = near.join(strings, "_key").withColumn("item", F.coalesce("_split", "_low"))
    ranked = named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).where(C("rank") <= top)
    return ranked.select("lang", "source", "item", "value", F.lit("term").alias("part"), "rank")
