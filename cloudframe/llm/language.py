"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters, lower-cased; a run of more than 24 letters (scripts without blanks) is cut into pieces of 24,
which are words each.  Affixes, letter n-grams and the whole word (lexicon) are hashed into one table of
weights; transitions between the labels of neighbouring words are learned too.  Forward-backward gives each word of a
text, code-switched or not, its label probabilities; a document has the language with the largest mean probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cloudframe.lineage import cut_lineage
from cloudframe.llm import common
from cloudframe.llm.common import C
from cloudframe.skew import MOST_BROADCAST

#: Rows of the weight table; most letters of a word.
TABLE, WIDTH = 1 << 16, 24
#: Most training documents of a language; parts trained side by side, whose weights are averaged; passes over the data.
SAMPLE_PER_LANGUAGE, PARTS, PASSES = 400, 4, 2
#: Words of a training sequence and of a piece of it: sequences are spliced from pieces of different documents.
SEQUENCE, PIECE = 96, 32
#: Letters that are labelled at a time (a longer text is taken alone): some 100 MB at most.
LETTERS_AT_ONCE = 1 << 20
UNKNOWN = "und"
_WORD = regex.compile(rf"\p{{L}}{{1,{WIDTH}}}")


def features(words: list[str]) -> np.ndarray:
    """Rows of the weight table for each word; ``TABLE`` is the empty row."""
    letters = np.array(words, f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
    length = (letters != 0).sum(axis=1)
    width = max(3, int(length.max(initial=0)))
    marked = np.zeros((len(words), width + 2), np.uint32)
    marked[:, 0], marked[:, 1:-1] = 2, letters[:, :width]
    marked[np.arange(len(words)), length + 1] = 3

    def row(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(parts[0].shape, 2166136261 + 7919 * kind, np.uint32)
        for part in parts:
            h = (h ^ part) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return (h & np.uint32(TABLE - 1)).astype(np.int32)

    two, three = row(2, marked[:, :-1], marked[:, 1:]), row(3, marked[:, :-2], marked[:, 1:-1], marked[:, 2:])
    two[np.arange(width + 1)[None, :] > length[:, None]] = TABLE
    three[np.arange(width)[None, :] >= length[:, None]] = TABLE
    last = np.take_along_axis(marked, np.maximum(length[:, None] + np.array([-2, -1, 0]), 0), axis=1)
    affix = [row(4, *marked[:, 1:4].T), row(5, *last.T)]
    power = np.array([pow(0x01000193, i, 1 << 32) for i in range(width)], np.uint32)
    whole = row(6, (letters[:, :width] * power).sum(axis=1, dtype=np.uint32))
    return np.column_stack([two, three, *affix, whole])


def chain(emit: np.ndarray, active: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward values, scaled, of sequences that are packed step by step, the longest first.

    ``active[t]`` sequences have a word ``t``; their rows follow one another in ``emit``.
    """
    at = np.concatenate(([0], np.cumsum(active)))
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    a = b = np.ones((active[0] if len(active) else 0, emit.shape[1]))
    b = b.copy()
    for t, n in enumerate(active):
        a = (emit[at[t]:at[t + 1]] * start) if t == 0 else (a[:n] @ step) * emit[at[t]:at[t + 1]]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at[t]:at[t + 1]] = a
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        beta[at[t]:at[t + 1]] = b[:n]
        before = (emit[at[t]:at[t + 1]] * b[:n]) @ step.T
        b[:n] = before / before.sum(axis=1, keepdims=True)
    return alpha, beta


def pack(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: the packed place of each word, the sequence of each packed word, active counts."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    at = np.concatenate(([0], np.cumsum(active)))[:-1]
    total = int(lengths.sum())
    step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = at[step] + rank[owner] if total else np.zeros(0, np.int64)
    packed_owner = np.empty(total, np.int64)
    packed_owner[place] = owner
    return place, packed_owner, active


def _numbered(words: list[str]) -> tuple[np.ndarray, list[str]]:
    ids: dict[str, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    return numbers, list(ids)


def _scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    out = np.empty((len(words), weights.shape[1]))
    for i in range(0, len(words), 20_000):
        out[i:i + 20_000] = weights[features(words[i:i + 20_000])].sum(axis=1)
    return out


def _emit(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -30.0))


def train(texts: list[str], labels: np.ndarray, n_labels: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (one row more than the table), transitions and start scores, by stochastic gradient on the likelihood.

    Sequences are spliced from pieces of different documents, so that transitions between languages are seen.
    """
    rng = np.random.default_rng(seed)
    pieces = []
    for text, label in zip(texts, labels):
        words = _WORD.findall(text.lower())
        pieces += [(words[i:i + PIECE], label) for i in range(0, len(words), PIECE)]
    weights, steps, start = np.zeros((TABLE + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    seen = [np.full(x.shape, 1e-2) for x in (weights, steps, start)]
    each = SEQUENCE // PIECE
    for _ in range(PASSES if pieces else 0):
        order = rng.permutation(len(pieces))
        for i in range(0, len(order), 64 * each):
            batch = [[pieces[k] for k in order[j:j + each]] for j in range(i, min(i + 64 * each, len(order)), each)]
            words = [w for seq in batch for p, _ in seq for w in p]
            truth = np.array([y for seq in batch for p, y in seq for _ in p])
            lengths = np.array([sum(len(p) for p, _ in seq) for seq in batch])
            place, owner, active = pack(lengths)
            numbers, types = _numbered(words)
            rows = features(types)
            emit = np.empty((len(words), n_labels))
            emit[place] = _emit(weights[rows].sum(axis=1))[numbers]
            gold = np.empty(len(words), np.int64)
            gold[place] = truth
            step = np.exp(steps)
            alpha, beta = chain(emit, active, step, np.exp(start))
            gamma = alpha * beta
            gamma /= gamma.sum(axis=1, keepdims=True)
            error = gamma.copy()
            error[np.arange(len(words)), gold] -= 1
            by_word = error[place]
            of_type = np.stack([np.bincount(numbers, by_word[:, k], len(types)) for k in range(n_labels)], axis=1)
            grad = np.stack([np.bincount(rows.ravel(), np.repeat(of_type[:, k], rows.shape[1]), TABLE + 1) for k in range(n_labels)], axis=1)
            at = np.concatenate(([0], np.cumsum(active)))
            grad_steps = np.zeros_like(steps)
            for t in range(1, len(active)):
                n = active[t]
                a, eb = alpha[at[t - 1]:at[t - 1] + n], emit[at[t]:at[t + 1]] * beta[at[t]:at[t + 1]]
                both = a[:, :, None] * step[None] * eb[:, None, :]
                grad_steps += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                np.add.at(grad_steps, (gold[at[t - 1]:at[t - 1] + n], gold[at[t]:at[t + 1]]), -1)
            n0 = active[0] if len(active) else 0
            grad_start = error[:n0].sum(axis=0)
            for x, g, s in zip((weights, steps, start), (grad, grad_steps, grad_start), seen):
                g = g / max(1, len(batch)) + 1e-6 * x
                s += g * g
                x -= 0.2 * g / np.sqrt(s)
            weights[TABLE] = 0
    return weights, steps, start


class Model:
    """Learned labels, weights, transitions and start scores; ``tag`` labels the words of texts."""

    def __init__(self, labels: list[str], weights: np.ndarray, steps: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.steps, self.start = labels, weights.astype(np.float32), steps, start

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Number of words of each text, all words, and their label probabilities."""
        found = [_WORD.findall(t.lower()) for t in texts]
        lengths = np.array([len(f) for f in found], np.int64)
        words = [w for f in found for w in f]
        numbers, types = _numbered(words)
        place, _, active = pack(lengths)
        emit = np.empty((len(words), len(self.labels)))
        if len(words):
            emit[place] = _emit(_scores(types, self.weights))[numbers]
        alpha, beta = chain(emit, active, np.exp(self.steps), np.exp(self.start))
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        return lengths, words, gamma[place]

    def shares(self, texts: list[str]) -> np.ndarray:
        """Mean label probabilities of each text; zeros without letters.  Few texts are labelled at a time."""
        out, i = np.zeros((len(texts), len(self.labels))), 0
        while i < len(texts):
            j, letters = i, 0
            while j < len(texts) and (j == i or letters + len(texts[j]) <= LETTERS_AT_ONCE):
                letters += len(texts[j])
                j += 1
            lengths, _, gamma = self.tag(texts[i:j])
            owner = np.repeat(np.arange(j - i), lengths)
            sums = np.stack([np.bincount(owner, gamma[:, k], j - i) for k in range(len(self.labels))], axis=1)
            out[i:j] = sums / np.maximum(lengths, 1)[:, None]
            i = j
        return out


def held_out(doc_id: Column) -> Column:
    """Is the crc32 of the id as text 2 modulo 4?  A NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Learn from ``text`` and non-null ``lang`` of the rows that are not held out; None if there are none.

    At most ``per_language`` documents of each language, the first by hash, are learned from; only their texts are
    shuffled.  The model has 256 kB a language and is meant for labels that are languages, not for free text.
    """
    usable = docs.where(C(lang).isNotNull() & C(text).isNotNull() & ~held_out(C(doc_id)))
    rows = usable.select(C(lang).cast("string").alias("_lang"), C(doc_id).alias("_id"), common.text_key(text).alias("_hash"), C(text).alias("_text"))
    chosen = cut_lineage(common.first_by_hash(rows.drop("_text").distinct(), "_lang", ["_id", "_hash"], per_language)
                         .withColumnsRenamed({"_id": "_id2", "_hash": "_hash2", "_lang": "_lang2"}))
    labels = sorted((r[0] for r in chosen.select("_lang2").distinct().collect()), key=lambda x: x.encode())
    if not labels:
        return None
    meet = C("_hash").eqNullSafe(C("_hash2")) & C("_id").eqNullSafe(C("_id2")) & (C("_lang") == C("_lang2"))
    named = F.broadcast(chosen) if len(labels) * per_language <= MOST_BROADCAST else chosen
    sample = rows.join(named, meet).select("_lang", "_text", "_no", F.pmod(C("_no"), F.lit(PARTS)).alias("_part")).dropDuplicates(["_lang", "_no"])
    number = {label: i for i, label in enumerate(labels)}

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_lang", "_no"])
        weights, steps, start = train(frame["_text"].tolist(), frame["_lang"].map(number).to_numpy(), len(labels), int(frame["_part"].iloc[0]))
        blob = np.concatenate([weights.ravel(), steps.ravel(), start]).astype(np.float32)
        return pd.DataFrame({"part": frame["_part"].iloc[:1], "model": [blob.tobytes()]})

    blobs = sample.groupBy("_part").applyInPandas(part, "part int, model binary").orderBy("part").collect()  # PARTS tables of fixed size
    mean = np.mean([np.frombuffer(b["model"], np.float32) for b in blobs], axis=0).astype(np.float64)
    n, size = len(labels), (TABLE + 1) * len(labels)
    return Model(labels, mean[:size].reshape(-1, n), mean[size:size + n * n].reshape(n, n), mean[size + n * n:])


def identify(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns: the language and its mean probability over the words.

    ``und`` with score 0 if the text is NULL or has no letter, or if nothing was learned.  Equal shares: the first label.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.labels, model.weights, model.steps, model.start))
    names = [*docs.columns, lang, score]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value and Model(*shared.value)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(at)]
            label, value = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if learned is not None and texts:
                shares = learned.shares(texts)
                for k, best in enumerate(shares.argmax(axis=1)):
                    if shares[k, best] > 0:
                        label[k], value[k] = learned.labels[best], min(1.0, float(shares[k, best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(value, pa.float64())], names)

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, least: float = 0.3, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is known with a score of ``least``."""
    label, score = common.fresh(docs, "lang_pred", "lang_score")
    return identify(docs, fit(docs, doc_id, text, lang), text, label, score).where((C(label) != UNKNOWN) & (C(score) >= least)).select(*docs.columns)
