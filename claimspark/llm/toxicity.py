"""Toxicity scores from subword-bag embeddings with a linear softmax.

A word is the bag of its character n-grams (with border marks) and itself,
hashed to buckets; its vector is the mean of the buckets' embeddings, a
document's vector the mean over its words, and a linear softmax on top gives
the class. Embeddings and softmax are trained jointly in numpy, so a misspelt
word that was never seen shares the vectors of its n-grams.

The model is fitted in one task on a bounded sample of labelled rows
(``max_per_class``, ``max_chars``); scoring is a narrow pass over every whole
text. As the model is linear, scoring needs one number per bucket.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold

BUCKETS = 1 << 20
DIM = 8
GRAMS = (3, 4, 5, 6)
EPOCHS = 60
RATE = 0.05
#: The mean over a document's words is scaled by this, as a few words of hundreds decide.
SCALE = 64.0
DECAY = 1e-4
#: Documents that a bucket must stand in to be trained.
MIN_DOCUMENTS = 3
#: Word occurrences per document of the sample beyond which a bucket is not trained.
MOST = 0.5
#: A text of fewer words is averaged as if it were filled up with words without meaning.
LEAST_WORDS = 30
#: Labelled documents of each class, and characters in all, that the fit takes at most.
MAX_PER_CLASS = 1500
MAX_CHARS = 24_000_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def buckets_of(word: str) -> list[int]:
    """Buckets of the word and of its n-grams."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


class Bags:
    """A sparse matrix of weighted bags; multiplies both ways with sorted sums."""

    def __init__(self, row: np.ndarray, col: np.ndarray, weight: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.ways = []
        for to, of, n in ((row, col, shape[0]), (col, row, shape[1])):
            order = np.argsort(to, kind="stable")
            there, first = np.unique(to[order], return_index=True)
            self.ways.append((of[order].astype(np.int32), weight[order].astype(np.float32), there, first, n))

    def times(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        of, weight, there, first, n = self.ways[back]
        out = np.zeros((n, x.shape[1]), np.float32)
        if len(there):
            for k, column in enumerate(np.ascontiguousarray(x.T)):  # one at a time: the products are as long as the matrix has entries
                out[there, k] = np.add.reduceat(column[of] * weight, first)
        return out


def fit(texts: list[str], labels: np.ndarray, seed: int = 42) -> dict[str, np.ndarray]:
    """Train embeddings and softmax jointly (Adam, whole batch, classes weighed equally)."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    rows, cols = [], []
    for k, text in enumerate(texts):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)]
        rows.append(np.full(len(ids), k))
        cols.append(np.array(ids, np.int64))
    row, col = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64), np.concatenate([np.empty(0, np.int64), *cols])
    length = np.bincount(row, minlength=len(texts)).clip(LEAST_WORDS)
    pair, count = np.unique(row * max(1, len(vocabulary)) + col, return_counts=True)
    row, col = pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))
    documents = Bags(row, col, SCALE * count / length[row], (len(texts), len(vocabulary)))
    grams = [np.array(buckets_of(w), np.int32) for w in vocabulary]
    sizes = np.fromiter(map(len, grams), np.int32, len(grams))
    of_word = np.repeat(np.arange(len(grams), dtype=np.int32), sizes)
    flat = np.concatenate([np.empty(0, np.int32), *grams])
    # buckets of one or two documents would learn these by heart, those of nearly all tell nothing
    held_by = np.bincount(flat, np.bincount(col, minlength=len(grams))[of_word], BUCKETS) if len(flat) else np.zeros(BUCKETS)
    trained = (held_by >= MIN_DOCUMENTS) & (held_by <= MOST * len(texts))
    kept, used = np.flatnonzero(trained), trained[flat]
    words = Bags(of_word[used], np.searchsorted(kept, flat[used]), (1.0 / sizes[of_word])[used], (len(grams), len(kept)))

    target = np.eye(2, dtype=np.float32)[labels]
    share = target.mean(axis=0)
    weight = (target @ (0.5 / np.maximum(share, 1e-9))).astype(np.float32)[:, None] / max(1, len(texts))
    state = {"embedding": rng.normal(0, 0.001, (len(kept), DIM)).astype(np.float32), "softmax": rng.normal(0, 1, (DIM, 2)).astype(np.float32),
             "bias": np.zeros((1, 2), np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in state.items()}
    for step in range(1, EPOCHS + 1 if len(texts) else 1):
        hidden = documents.times(words.times(state["embedding"]))
        logits = hidden @ state["softmax"] + state["bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) * weight
        slopes = {"embedding": words.times(documents.times(error @ state["softmax"].T, back=True), back=True) + DECAY * state["embedding"],
                  "softmax": hidden.T @ error, "bias": error.sum(axis=0, keepdims=True)}
        for k, slope in slopes.items():
            m, v = moments[k]
            m += 0.1 * (slope - m)
            v += 0.001 * (slope * slope - v)
            state[k] -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return state | {"buckets": kept}


def bucket_scores(model: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
    """The linear model in one number per bucket, and its bias, corrected for the share of the classes among all labels."""
    slope = model["softmax"][:, 1] - model["softmax"][:, 0]
    scores = np.zeros(BUCKETS, np.float32)
    scores[model["buckets"]] = SCALE * model["embedding"] @ slope
    share = float(np.clip(model.get("share", 0.5), 0.005, 0.995))
    return scores, float(model["bias"][0, 1] - model["bias"][0, 0]) + float(np.log(share / (1 - share)))


class WordScores(dict):
    """Word -> its mean bucket score, remembered up to ``limit`` words."""

    limit = 600_000

    def __init__(self, scores: np.ndarray):
        super().__init__()
        self.scores = scores.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        of = buckets_of(word)
        x = self[word] = sum(map(self.scores.__getitem__, of)) / len(of)
        return x


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of the labelled documents that are not held out; contradicting labels count as toxic."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    return known.filter(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def fit_sample(docs: DataFrame, known: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """Texts and labels to fit on: by hash order, at most ``max_per_class`` of each class.

    Chosen from the labels alone, so only the chosen documents' texts move.
    """
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = None
    for toxic in (0, 1):
        some = known.filter(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(max_per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("of"), F.col("text").cast("string"))
    # at most 2 * max_per_class ids: a proven bound
    joined = texts.join(F.broadcast(chosen), texts["of"] == chosen["doc_id"]).select("doc_id", "toxic", "text")
    return joined.orderBy(order, "doc_id", "text").limit(2 * max_per_class)


def within(rows: pd.DataFrame, max_chars: int) -> pd.DataFrame:
    """Rows ``doc_id, toxic, text`` that the fit takes: all of them, or of each class as many as fit.

    A class has half of ``max_chars`` and what the other one leaves. Where it
    has more, its rows come in hash order, those of over a 16th of its share
    last; a row that doesn't fit is skipped. If none fits, the shortest is
    cut to the share, so that no class is lost.
    """
    length = rows["text"].str.len()
    if length.sum() <= max_chars:
        return rows
    totals = {c: int(length[rows["toxic"] == c].sum()) for c in (0, 1)}
    kept = []
    for c in (0, 1):
        room = share = max(max_chars // 2, max_chars - totals[1 - c])
        own = rows[rows["toxic"] == c]
        order = sorted(((16 * n > share, hashlib.md5(str(d).encode()).hexdigest(), t, k) for k, d, t, n in zip(own.index, own["doc_id"], own["text"], length[own.index])))
        some = []
        for _, _, text, k in order:
            if len(text) <= room:
                room -= len(text)
                some.append(k)
        if some:
            kept.append(own.loc[some])
        elif len(own):
            shortest = own.loc[[min(order, key=lambda o: (len(o[2]), o[1:]))[3]]]
            kept.append(shortest.assign(text=shortest["text"].str[:share]))
    return pd.concat(kept)


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> dict[str, np.ndarray]:
    """Fit on the bounded sample in one task; the model (a few MB whatever the corpus) comes to the driver."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = within(rows.assign(text=rows["text"].fillna("")), max_chars).sort_values(["doc_id", "text"], kind="stable")
        hold("")  # the fit needs the room
        out = io.BytesIO()
        np.savez_compressed(out, **fit(rows["text"].tolist(), rows["toxic"].to_numpy(np.int64)))
        return pd.DataFrame({"model": [out.getvalue()]})

    known = known_labels(labels)
    sample = fit_sample(docs, known, max_per_class).withColumn("one", F.lit(1))
    found = sample.groupBy("one").applyInPandas(run, "model binary").first()
    if found is None:
        return fit([], np.empty(0, np.int64))
    share = known.agg(F.avg("toxic")).first()[0]
    with np.load(io.BytesIO(found["model"])) as arrays:
        return {k: arrays[k] for k in arrays.files} | {"share": np.array(share)}


def score(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null and empty texts get the score of the bias. Whole texts are scored;
    labels, language, source and id play no part. Other columns are not read.
    """
    scores, bias = bucket_scores(model)

    def run(batches):
        memory = WordScores(scores)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                out[k] = sum(map(memory.__getitem__, words)) / max(len(words), LEAST_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out + bias, -60, 60))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``; a narrow pass."""
    scores, bias = bucket_scores(model)
    limit = float(np.log(threshold / (1 - threshold))) - bias

    def run(batches):
        memory = WordScores(scores)
        for batch in batches:
            stays = []
            for text in batch.column(batch.schema.names.index("text")):
                words = words_of(text.as_py())
                stays.append(sum(map(memory.__getitem__, words)) / max(len(words), LEAST_WORDS) < limit)
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
