"""Exact and near duplicates and repeated strings against brute force."""

import hashlib
import random
import re
import string
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cloudframe.lineage import cut_lineage
from cloudframe.llm import common, exact, graph, jaccard, queries, simhash, suffixes

from .conftest import SMALL

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def exact_brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for t, ids in groups.items():
        keep, kept = max((i for i in ids if i is not None), default=None), False
        for i in ids:
            now = i == keep and not kept
            kept |= now
            out.append((i, keep, len(ids), now, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 2048])
def test_exact_groups_of_odd_rows(odd, block):
    pairs = [(r.doc_id, r.text) for r in odd.collect()]
    got = exact.exact_groups(odd.where("length(text) < 5000 or text is null"), block=block)
    want = exact_brute([(i, t) for i, t in pairs if t is None or len(t) < 5000])
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_long_text_and_empty_table(odd, empty):
    long = odd.where("length(text) >= 5000")
    assert rows(exact.exact_groups(long), "doc_id", "group_size", "kept") == rows(long.select("doc_id", F.lit(1).alias("n"), F.lit(True).alias("k")), "doc_id", "n", "k")
    assert exact.exact_groups(empty).count() == 0 and exact.keep_one(empty).columns == empty.columns


def test_names_do_not_depend_on_a_hash(spark):
    same = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit(1).alias("rest"))
    names = exact.named(same, ["v"], ["k"]).join(same, "k").select("v", "name").distinct().collect()
    assert len(names) == 7 and len({r.name for r in names}) == 7


def test_exact_keep_one_keeps_columns_and_one_row_a_group(odd):
    kept = exact.keep_one(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({(t or "").translate(LOWER) for t, in odd.select("text").collect()})


def test_summary_and_lookup_of_a_hot_key(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 5).alias("k"))
    got = {tuple(r) for r in common.summary_by_group(df, ["k"], ["id"], {"least": ("min", "id"), "all": ("sum", "id")}).select("k", "least", "all").collect()}
    assert got == {tuple(r) for r in df.groupBy("k").agg(F.min("id"), F.sum("id")).collect()}
    table = df.groupBy("k").agg(F.count("*").alias("n"))
    assert common.lookup(df, table, ["k"], ["id"]).where("k is null and n = 666").count() == 666


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = list(fps)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_simhash_query_against_brute_force(spark, small):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op3_simhash"](spark, SMALL).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in small.collect()}
    groups = brute_components(fps)
    assert got == {i: (f"{f:016x}", groups[i]) for i, f in fps.items()}


@pytest.mark.parametrize("bits", [6, 8, 13])
def test_ball_hashing_connects_all_within_the_radius(spark, bits):
    rng = np.random.default_rng(bits)
    fps = set(rng.integers(0, 1 << 63, 60).tolist())
    for f in list(fps):
        for _ in range(3):
            f ^= int(np.bitwise_or.reduce(np.int64(1) << rng.choice(63, rng.integers(1, 6), replace=False)))
            fps.add(f)
    fps |= {0, 1, 3, 7, 15, 31, -1}
    frame = spark.createDataFrame([(f,) for f in fps], "_fp long")
    links = simhash.links(frame, bucket_bits=bits)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    roots = {r.node: r.root for r in graph.components(links).collect()}
    want = brute_components({f: f & (1 << 64) - 1 for f in sorted(fps)})
    assert {f: roots.get(f, f) for f in fps} == want


def test_components_of_a_star_a_path_and_nothing(spark):
    star = [(0, i) for i in range(1, 300)]
    path = [(i, i + 1) for i in range(1000, 1064)]
    edges = spark.createDataFrame(star + path + [(5, 5)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{i: 1000 for i in range(1000, 1065)}}
    assert graph.components(edges.where("false")).count() == 0


def test_near_duplicates_of_odd_rows(odd, empty):
    got = simhash.near_groups(odd)
    assert got.count() == odd.count()
    blank = got.where("_fp = 0 and _id is not null").select("component_id").distinct().collect()
    assert [r.component_id for r in blank] == [0]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert simhash.near_groups(empty).count() == 0


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(d, covered) if not c)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((len(d), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [40, 64])
def test_repeated_strings_against_brute_force(spark, length):
    random.seed(length)
    texts = ["".join(random.choice("abé ") for _ in range(random.randint(0, 300))) for _ in range(40)]
    for _ in range(30):
        a = random.choice(texts)
        x = random.randint(0, len(a))
        texts.append("left" * random.randint(0, 9) + a[x:random.randint(x, len(a))] + "right" * random.randint(0, 9))
    texts += ["a" * 500, "a" * 39, "a" * 40, "ab" * 100, "ab" * 90 + "c", None, "", texts[0], texts[0], "\0" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.remove_repeats(df, length=length).select("_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).orderBy("_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts, length)


def test_repeated_strings_query(spark, small):
    got = queries.QUERIES["op8_repeats"](spark, SMALL).orderBy("doc_id").collect()
    texts = [r.text for r in small.orderBy("doc_id").collect()]
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts, 400)


def test_repeated_strings_of_repeated_rows_and_ids(odd, empty):
    got = suffixes.remove_repeats(odd).groupBy("_id", "n_bytes", "n_removed").count().where("_id = 5").collect()
    assert [(r.n_removed == r.n_bytes, r["count"]) for r in got] == [(True, 3)]
    assert suffixes.remove_repeats(odd).count() == odd.count() and suffixes.remove_repeats(empty).count() == 0


def test_bodies_around_sampled_places_need_no_second_search(monkeypatch):
    data = bytes(random.Random(3).choices(b"abcd ", k=5000))
    gram, place, first, last = suffixes.sampled(np.frombuffer(data, np.uint8), 400)
    packed = suffixes._packed(place, first, last, 400)
    monkeypatch.setattr(suffixes, "sampled", None)
    found = [x[1:] for x in suffixes._around(data, packed.tolist()[::-1], 400)]
    assert found == list(zip(gram.tolist(), packed.tolist(), place.tolist(), first.tolist(), last.tolist())) and len(found) > 10


@pytest.mark.parametrize("meeting", [1000, 2])
def test_meetings_of_sets_are_whole_when_shingles_are_dealt_out(spark, monkeypatch, meeting):
    monkeypatch.setattr(jaccard, "MEETING", meeting)
    draw = random.Random(4)
    keys = {i: sorted(draw.sample(range(40), draw.randint(0, 6))) + [99] * (i % 2) for i in range(60)}
    rows = spark.createDataFrame([(i, len(k), k) for i, k in keys.items()], "_set long, _size int, _keys array<bigint>")
    number = Counter(k for ks in keys.values() for k in ks)
    want = sorted((k, i, len(ks), at) for i, ks in keys.items() for at, k in enumerate(ks) if number[k] > 1)
    assert sorted(tuple(r) for r in jaccard._meetings(rows, rows).collect()) == want


def test_sorting_on_disk_gives_the_same(monkeypatch):
    random.seed(1)
    right = sorted(bytes(random.choice(b"ab") for _ in range(12)) for _ in range(200))
    left = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 5))) for _ in right]
    args = ([1] * 200, left, right, [0] * 200, [1] * 200, 12)
    in_memory = suffixes._sorted_part(*args)
    monkeypatch.setattr(suffixes, "IN_MEMORY", 10)
    assert suffixes._sorted_part(*args) == in_memory and any(f for f, _ in in_memory)


def test_first_by_hash_of_a_large_and_a_small_key(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") < 7, "few").otherwise("many").alias("k"))
    got = common.first_by_hash(df, "k", ["id"], 50).collect()
    want = [r.id for r in df.where("k = 'many'").orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    assert [r.id for r in sorted(got, key=lambda r: r._no) if r.k == "many"] == want
    assert sorted(r.id for r in got if r.k == "few") == list(range(7))


def test_counts_bound_the_overlap():
    draw = np.random.default_rng(5)
    for _ in range(300):
        pool = draw.integers(-2 ** 63, 2 ** 63 - 1, 600, dtype=np.int64)
        if draw.random() < 0.2:
            pool = np.arange(600) - 300  # all in two ranges
        a, b = (np.unique(draw.choice(pool, draw.integers(1, 600))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        counts = jaccard.counts_of(a), jaccard.counts_of(b)
        assert both <= jaccard.most_overlap(*counts) == jaccard.most_overlap(*counts[::-1]) <= min(len(a), len(b))
        assert jaccard.most_overlap(counts[0], counts[0]) == len(a)


def test_values_reach_every_pair_of_a_hot_set(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TOGETHER", 3)
    pairs = [(1, b) for b in range(2, 40)] + [(2, 5), (38, 39)]
    pairs = spark.createDataFrame(pairs, "a bigint, b bigint")
    whole = spark.createDataFrame([(i, bytes([i])) for i in range(50)], "_set bigint, _all binary")
    got = jaccard._with_sets(pairs, pairs, whole, "_all", "a", "b")
    got = jaccard._with_sets(got, pairs, whole, "_all", "b", "a").collect()
    assert sorted((r.a, r.b) for r in got) == sorted(map(tuple, pairs.collect()))
    assert all((bytes(r._a), bytes(r._b)) == (bytes([r.a]), bytes([r.b])) for r in got)


def brute_near(texts):
    """The smallest number in each group that pairs with a Jaccard similarity of 0.8 connect."""
    sets = []
    for t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((group[i], group[j]))
                group = [x if g == y else g for g in group]
    return group


def edited(random_, n, edits, words):
    """``n`` copies of a text, each with a few words replaced."""
    out = []
    for _ in range(n):
        copy = list(words)
        for _ in range(random_.randint(0, edits)):
            copy[random_.randrange(len(copy))] = f"w{random_.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("pairs", [16, 0])
def test_near_duplicates_are_those_of_the_stage_rule(spark, monkeypatch, pairs):
    """At similarities around 0.8, where fingerprints mostly differ in more than 4 of 64 bits."""
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    r, texts = random.Random(3), []
    passage = [f"p{i}" for i in range(60)]  # one that all have
    for _ in range(6):
        texts += edited(r, 12, 5, passage + [f"w{r.randrange(10**6)}" for _ in range(r.randint(30, 200))])
    texts += ["", None, "A b", "a  B", "one two three four five", "one two three four six"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(brute_near(texts))
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, None).collect()} == want
    assert len(set(brute_components({i: brute_fingerprint(t) for i, t in enumerate(texts)}).values())) > len(want)


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for folder in folders for f in Path(folder.getPath()).rglob("shuffle_*.data")}


def test_shuffle_files_go_when_a_table_is_written_or_checkpointed(spark):
    before, name = shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name)
    numbers = spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count()
    kept = [cut_lineage(numbers), common.written(numbers, "test")[0], cut_lineage(numbers)]
    assert [x.agg(F.sum("count")).first()[0] for x in kept] == [20_000] * 3 and spark.conf.get(name) == setting
    kept = [cut_lineage(numbers.withColumn("n", F.lit(i))) for i in range(3)]
    for _ in range(50):  # files are deleted in the background
        if len(left := shuffle_files(spark) - before) <= 3 * 4:  # those of the three sums above
            break
        time.sleep(0.1)
    assert len(left) <= 3 * 4


def test_rows_are_found_again_in_one_move(spark):
    text = [(None, "a"), (None, "a"), (None, None), (1, "a"), (1, "b"), (1, "b"), (2, "c"), (None, "z")]
    docs = spark.createDataFrame(text, "doc_id long, text string")
    chosen = docs.where("text is null or text <> 'z'").where("doc_id is null or doc_id < 2").select(F.col("doc_id").alias("_id"), common.text_key("text").alias("_hash"))
    found = common.rows_of(docs, chosen, "doc_id", "text", once=True)
    assert Counter(tuple(r) for r in found.collect()) == Counter({(None, "a"), (None, None), (1, "a"), (1, "b")})
    assert Counter(tuple(r) for r in common.rows_of(docs, chosen, "doc_id", "text").collect()) == Counter(text[:6])
    plan = common.rows_of(docs, chosen.hint("merge"), "doc_id", "text", once=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the rows, and those named


def test_sets_are_sent_once_for_both_sides(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(20) for b in range(a + 1, 20)], "a bigint, b bigint").hint("merge")
    whole = spark.createDataFrame([(i, bytes([i])) for i in range(20)], "_set bigint, _all binary").hint("merge")
    hot = jaccard._hot_sets(pairs)
    got = jaccard._with_sets(jaccard._with_sets(pairs, pairs, whole, "_all", "a", "b", hot), pairs, whole, "_all", "b", "a", hot)
    assert sorted((r.a, r.b, bytes(r._a), bytes(r._b)) for r in got.collect()) == [(a, b, bytes([a]), bytes([b])) for a in range(20) for b in range(a + 1, 20)]
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_near_groups_of_copies_with_many_edits(spark, monkeypatch):
    """Copies with so many edits that most pairs are not similar: a chain connects them, and not all pairs are compared."""
    monkeypatch.setattr(jaccard, "PAIRS", 0)
    compared, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: (compared.append(pairs.distinct().count()), verified(pairs, *rest))[1])
    r = random.Random(8)
    texts = edited(r, 240, 5, [f"w{i}" for i in range(150)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, None).collect()} == set(brute_near(texts))
    assert sum(compared) < 240 * 239 / 2 / 2
