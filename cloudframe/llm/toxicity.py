"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms that go with the label (exact binomial test, Benjamini-Hochberg) span the vector space; how common
each is comes from all documents.  A component that all texts share anchors
the vectors, so that a text with one such term is not as near to a text full of them as direction alone would say.  The labelled sample is indexed by term in blocks of examples, each with its largest
weight, so that blocks which cannot hold a nearer example are skipped and the result is exact.  Votes of the neighbours,
weighted by nearness, become probabilities by isotonic regression on the examples, each without itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cloudframe.lineage import cut_lineage
from cloudframe.llm import common
from cloudframe.llm.common import C

#: Most labelled examples of each label; neighbours that vote; examples in a block; share of false terms accepted.
EXAMPLES_PER_LABEL, NEIGHBOURS, BLOCK, FALSE_TERMS = 2000, 15, 64, 0.05
#: Fewest examples that must have a term; weight of the anchor, against the mean of the terms.
FEWEST, ANCHOR = 3, 0.5
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Is the crc32 of the id as text 0 modulo 5?  A NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def significant(counts: np.ndarray, n1: int, n0: int, share: float = FALSE_TERMS) -> np.ndarray:
    """Which rows ``(examples with the label, examples without)`` of ``counts`` go with the label.

    Exact binomial test: could so many of the examples that have the term be of the label by chance?
    """
    if not len(counts) or not n1 or not n0:
        return np.zeros(len(counts), bool)
    pairs, back = np.unique(counts, axis=0, return_inverse=True)
    logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, counts.sum(axis=1).max() + 1)))))  # of factorials
    yes, no = math.log(n1 / (n1 + n0)), math.log(n0 / (n1 + n0))

    def tail(a: int, b: int) -> float:
        n, k = a + b, np.arange(a, a + b + 1)
        return float(np.exp(logs[n] - logs[k] - logs[n - k] + k * yes + (n - k) * no).sum())

    p = np.array([min(1.0, tail(int(a), int(b))) for a, b in pairs])[back.ravel()]
    ordered = np.sort(p)
    good = np.flatnonzero(ordered <= share * np.arange(1, len(p) + 1) / len(p))
    return p <= ordered[good[-1]] if len(good) else np.zeros(len(p), bool)


class Index:
    """Block-max inverted index of unit vectors; row ``i`` of ``vectors`` is ``(terms, weights)``."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        main = [t[np.argmax(w)] if len(t) else n_terms for t, w in vectors]
        self.order = np.lexsort((np.arange(len(vectors)), main))  # like with like, so that the bounds of blocks are tight
        self.block, self.blocks = block, -(-len(vectors) // block)
        terms = np.concatenate([vectors[i][0] for i in self.order] + [np.zeros(0, np.int64)]).astype(np.int64)
        weights = np.concatenate([vectors[i][1] for i in self.order] + [np.zeros(0)])
        rows = np.repeat(np.arange(len(vectors)), [len(vectors[i][0]) for i in self.order])
        by = np.lexsort((rows, terms))
        self.rows, self.weights = rows[by], weights[by]
        slot = terms[by] * self.blocks + self.rows // block
        self.start = np.searchsorted(slot, np.arange(n_terms * self.blocks + 1)).reshape(-1)
        self.most = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.most, slot, self.weights)
        self.most = self.most.reshape(n_terms, self.blocks)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples (numbers as given) with the largest positive cosine, and the cosines; ties by number."""
        bound = weights @ self.most[terms] if len(terms) else np.zeros(self.blocks)
        found, scores, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or bound[b] + 1e-9 < least:
                break
            out = np.zeros(self.block)
            for t, w in zip(terms, weights):
                lo, hi = self.start[t * self.blocks + b], self.start[t * self.blocks + b + 1]
                out[self.rows[lo:hi] - b * self.block] += w * self.weights[lo:hi]
            here = np.flatnonzero(out > 0)
            numbers = self.order[here + b * self.block]
            here, numbers = here[numbers != without], numbers[numbers != without]
            found, scores = np.concatenate((found, numbers)), np.concatenate((scores, out[here]))
            best = np.lexsort((found, -np.round(scores, 12)))[:k]
            found, scores = found[best], scores[best]
            least = scores[-1] if len(scores) == k else 0.0
        return found, scores


def unit(numbers: list[int], times: list[int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF vector of length 1; its last component, the anchor, is the same before scaling whatever the text."""
    t = np.array([*numbers, len(idf) - 1], np.int64)
    w = (1 + np.log(np.array([*times, 1], float))) * idf[t]
    return t, w / np.sqrt((w * w).sum())


def vote(labels: np.ndarray, scores: np.ndarray) -> float:
    return float((labels * scores).sum() / scores.sum()) if len(scores) else -1.0


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the increasing fit of ``y``: values of ``x`` and of the fit there (pool adjacent violators)."""
    points = np.unique(x)
    at = np.searchsorted(points, x)
    w = np.bincount(at, weight)
    mean = np.bincount(at, weight * y) / w
    pools: list[list[float]] = []
    for value, n in zip(mean, w):
        pools.append([value, n, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, n2, c = pools.pop()
            u, n1, d = pools.pop()
            pools.append([(u * n1 + v * n2) / (n1 + n2), n1 + n2, c + d])
    return points, np.concatenate([np.full(int(c), v) for v, _, c in pools]) if pools else points


def _examples(labels: DataFrame, doc_id: str, label: str, per_label: int) -> DataFrame:
    """``_id2, _label``: at most ``per_label`` rows of each label, the first by hash; a document with both is toxic."""
    one = (labels.where(C(label).isNotNull() & C(doc_id).isNotNull() & ~held_out(C(doc_id)))
           .groupBy(C(doc_id).alias("_id2")).agg(F.max((C(label) == 1).cast("int")).alias("_label")))
    return common.first_by_hash(one, "_label", ["_id2"], per_label).drop("_no")


def _terms_of(examples: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1)):
                words = sorted(set(_WORD.findall((text.as_py() or "").lower())))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([label.as_py()] * len(words), pa.int32())], ["term", "label"])

    return examples.mapInArrow(run, "term string, label int")


def _counted(docs: DataFrame, doc_id: str, text: str, terms: list[str]) -> DataFrame:
    """``_id, _hash, _terms, _counts`` of every row; terms by number."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    rows = docs.select(C(doc_id).alias("_id"), common.text_key(text).alias("_hash"), C(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            found = [sorted(Counter(number[w] for w in _WORD.findall((t.as_py() or "").lower()) if w in number).items()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.int32())),
                                              pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))], ["_id", "_hash", "_terms", "_counts"])

    return rows.mapInArrow(run, f"_id {docs.schema[doc_id].dataType.simpleString()}, _hash bigint, _terms array<int>, _counts array<int>")


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          per_label: int = EXAMPLES_PER_LABEL, k: int = NEIGHBOURS) -> DataFrame:
    """Every row of ``docs``: ``_id, _hash, score, neighbours, terms``, with the evidence.

    ``neighbours`` are ``(doc_id, cosine, label)`` of the nearest examples other than the row itself, ``terms`` the words
    of the vector space that the text has.  Texts without such words (NULL and empty texts too) are nearest to
    examples without any.  If there are no labels of both kinds, the score is the share of toxic labels, 0 without labels.
    """
    examples = cut_lineage(_examples(labels, doc_id, label, per_label))  # 2 * per_label rows at most
    train = labels.where(C(label).isNotNull() & C(doc_id).isNotNull() & ~held_out(C(doc_id)))
    share = {r[0]: r[1] for r in train.groupBy((C(label) == 1).cast("int")).count().collect()}
    texts = docs.select(C(doc_id).alias("_id"), C(text).alias("_text")).join(F.broadcast(examples), C("_id") == C("_id2"))
    in_sample = {r[0]: r[1] for r in examples.groupBy("_label").count().collect()}
    n1, n0 = in_sample.get(1, 0), in_sample.get(0, 0)
    counts = (_terms_of(texts.select("_text", "_label")).groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - C("label")).alias("b"))
              .where(C("a") + C("b") >= FEWEST).orderBy("term").toPandas())  # words of the bounded sample
    kept = significant(counts[["a", "b"]].to_numpy(np.int64).reshape(-1, 2), n1, n0)
    terms = counts["term"][kept].tolist()
    vectors = cut_lineage(_counted(docs, doc_id, text, terms))
    total = vectors.count()
    common_ = {r[0]: r[1] for r in vectors.select(F.explode("_terms").alias("t")).groupBy("t").count().collect()}  # one row per term
    idf = np.array([math.log((total + 1) / (common_.get(i, 0) + 1)) + 1 for i in range(len(terms))])

    idf = np.append(idf, ANCHOR * idf.mean() if len(idf) else 1.0)
    known = vectors.join(F.broadcast(examples), C("_id") == C("_id2")).dropDuplicates(["_id"]).orderBy("_id").collect()  # 2 * per_label rows at most
    given, marks = [r["_id"] for r in known], np.array([r["_label"] for r in known], float)
    units = [unit(r["_terms"], r["_counts"], idf) for r in known]
    index = Index(units, len(idf))
    votes = np.array([vote(marks[f], s) for f, s in (index.nearest(*u, k, i) for i, u in enumerate(units))])
    # The sample has as many of either label; weights restore their shares among all labelled rows.
    weight = np.where(marks == 1, share.get(1, 0) / max(1, n1), share.get(0, 0) / max(1, n0))
    steps = isotonic(votes, marks, weight) if len(votes) else (np.array([-1.0]), np.array([float(bool(share.get(1, 0)))]))
    own = {g: i for i, g in enumerate(given)}
    shared = docs.sparkSession.sparkContext.broadcast((given, marks, own, steps, terms, idf, vars(index)))
    kind = docs.schema[doc_id].dataType.simpleString()
    evidence = pa.struct([("doc_id", pa.from_numpy_dtype("int64") if kind == "bigint" else pa.string()), ("cosine", pa.float64()), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, marks, own, (points, fit), terms, idf, state = shared.value
        index = Index.__new__(Index)
        index.__dict__.update(state)
        for batch in batches:
            scores, near, words, seen = [], [], [], {}
            for id_, numbers, times in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                key = (tuple(numbers), tuple(times), own.get(id_, -1))
                if key not in seen:
                    seen[key] = index.nearest(*unit(numbers, times, idf), k, key[2])
                found, cosines = seen[key]
                near.append([{"doc_id": given[i] if kind == "bigint" else str(given[i]), "cosine": float(s), "label": int(marks[i])} for i, s in zip(found, cosines)])
                words.append([terms[i] for i in numbers])
                scores.append(float(np.clip(np.interp(vote(marks[found], cosines), points, fit), 0, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(near, pa.list_(evidence)),
                                              pa.array(words, pa.list_(pa.string()))], ["_id", "_hash", "score", "neighbours", "terms"])

    type_ = "bigint" if kind == "bigint" else "string"
    return vectors.mapInArrow(run, f"_id {kind}, _hash bigint, score double, neighbours array<struct<doc_id:{type_},cosine:double,label:int>>, terms array<string>")
