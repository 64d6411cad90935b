"""Repeated passages, by subtrees of the corpus' suffix tree.

Only nodes ``window`` words deep matter, so the tree is cut there: its leaves are
the windows that start at every word. Suffixes are dealt by a prefix of variable
length, the one that ends with the window's smallest ``gram``-word gram (by
hash): equal windows have equal prefixes and meet, and consecutive suffixes
mostly share that gram, so that a run of them travels as one record. A
partition sorts the leaves of its subtrees; leaves that share a node at full
depth are repeats of the earliest one, and consecutive ones make up a maximal
repeat. Nodes are told apart by 64-bit hashes of their words within a task and
by prefix hash and 48 further bits across tasks.

Tasks remove local repeats before the shuffle, so that a passage that a third of
all documents share sends one leaf for each slice of a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, word_hashes

#: Words of documents that a task compares at once before it sends leaves on.
SLICE_WORDS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_NO_ID = np.iinfo(np.int64).max


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words, by doubling."""
    out, done, part, width = None, 0, h, 1
    while size:
        if size & 1:
            if out is None:
                out, done = part, width
            else:
                keep = len(out) - width
                out = out[:max(keep, 0)] * np.uint64(pow(_BASE, width, 1 << 64)) + part[done:done + max(keep, 0)]
                done += width
        size >>= 1
        if size:
            keep = max(len(part) - width, 0)
            part = part[:keep] * np.uint64(pow(_BASE, width, 1 << 64)) + part[width:width + keep]
            width *= 2
    return mix(out)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def leaves(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix key and hash of the window at each of a document's first words."""
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = word_hashes(words)
    return sliding_min(rolling(h, gram), window - gram + 1), rolling(h, window)


def _runs(breaks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs, from the places (1 to n - 1) where a run ends."""
    first = np.concatenate([[0], breaks]) if n else np.empty(0, np.int64)
    return first.astype(np.int64), np.diff(np.concatenate([first, [n]])).astype(np.int64)


def _records(docs: list[tuple], window: int, gram: int) -> list[tuple]:
    """Records ``key, doc_id, digest, start, n, leaves`` of a slice; without leaves: local repeats."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    keys, hashes, of, start = [], [], [], []
    for k, (doc_id, digest, words) in enumerate(docs):
        if k and docs[k - 1][:2] == (doc_id, digest):
            continue  # the same row again
        key, leaf = leaves(words, window, gram)
        keys.append(key)
        hashes.append(leaf)
        of.append(np.full(len(key), k))
        start.append(np.arange(len(key)))
    key, leaf, of, start = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, hashes, of, start))
    if not len(leaf):
        return []
    earliest = np.zeros(len(leaf), bool)
    earliest[np.unique(leaf, return_index=True)[1]] = True
    same = (of[1:] == of[:-1]) & (earliest[1:] == earliest[:-1]) & ((key[1:] == key[:-1]) | ~earliest[1:])
    first, n = _runs(np.flatnonzero(~same) + 1, len(leaf))
    short = np.ascontiguousarray(leaf[:, None].astype("<u8").view(np.uint8)[:, 2:]).tobytes()
    out = []
    for a, size, k, s, mine in zip(first.tolist(), n.tolist(), of[first].tolist(), start[first].tolist(), earliest[first].tolist()):
        doc_id, digest, _ = docs[k]
        out.append((key[a].view(np.int64), doc_id, digest, s, size, short[6 * a:6 * (a + size)]) if mine else (digest, doc_id, digest, s, size, None))
    return out


def _repeats(key, doc_id, digest, start, n, data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of records with whole subtrees: (record, first start, length) of the maximal repeats."""
    order = np.lexsort((start, digest, doc_id, key))
    n = n[order]
    row = np.repeat(np.arange(len(order)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[order][row]
    raw = np.zeros((len(row), 8), np.uint8)
    raw[:, :6] = np.frombuffer(b"".join(data[k] for k in order.tolist()), np.uint8).reshape(-1, 6)
    leaf = raw.view("<u8")[:, 0]
    subtree = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))[row]
    at = np.lexsort((leaf, subtree))  # stable: earlier places first
    new = np.concatenate([[True], (leaf[at][1:] != leaf[at][:-1]) | (subtree[at][1:] != subtree[at][:-1])])
    head = at[np.flatnonzero(new)][np.cumsum(new) - 1]  # the node's earliest leaf
    d, g = doc_id[order], digest[order]
    again = (d[row[at]] != d[row[head]]) | (g[row[at]] != g[row[head]]) | (place[at] != place[head])
    repeat = np.zeros(len(row), bool)
    repeat[at] = again
    where = np.flatnonzero(repeat)
    first, size = _runs(np.flatnonzero((np.diff(where) != 1) | (np.diff(row[where]) != 0)) + 1, len(where))
    return order[row[where[first]]], place[where[first]], size


def repeats(docs: DataFrame, window: int = 20, gram: int = 5, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``doc_id, digest, start, n``: runs of window starts that repeat an earlier window.

    ``docs``: ``doc_id, digest, text``. Earlier: smaller id (null last), then
    smaller digest, then earlier in the text.
    """
    def deal(batches):
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("leaves", pa.binary())])
        for batch in batches:
            held, size = [], 0
            for k, (doc_id, digest) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = (batch.column(2)[k].as_py() or "").encode().split()
                held.append((doc_id, digest, words))
                size += len(words)
                if size >= slice_words or k == batch.num_rows - 1:
                    rows = _records(held, window, gram)
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    held, size = [], 0

    def meet(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last subtree may go on
            yield from judged(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from judged(held)

    def judged(table):
        names = ["doc_id", "digest", "start", "n"]
        if not table.num_rows:
            return
        has = table.column("leaves").is_valid()
        local = table.filter(pa.compute.invert(has)).select(names)
        rows = table.filter(has).combine_chunks()
        out = [local.combine_chunks()]
        if rows.num_rows:
            key, digest, start, n = (rows.column(c).to_numpy() for c in ("key", "digest", "start", "n"))
            doc_id = rows.column("doc_id").fill_null(_NO_ID).to_numpy()
            record, first, size = _repeats(key, doc_id, digest, start, n, rows.column("leaves").to_pylist())
            found = rows.select(names).take(pa.array(record, pa.int64()))
            out.append(found.set_column(2, "start", pa.array(first, pa.int64())).set_column(3, "n", pa.array(size, pa.int64())))
        for t in out:
            yield from t.to_batches()

    records = docs.select("doc_id", "digest", "text").mapInArrow(deal, "key long, doc_id long, digest long, start long, n long, leaves binary")
    return records.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "doc_id long, digest long, start long, n long")


def substring_dedup(docs: DataFrame, window: int = 20, gram: int = 5, slice_words: int = SLICE_WORDS, keep_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, the text that stays).

    Every word that a repeated window covers is removed; windows are judged on
    the input. Words are runs without [\\x20\\x09-\\x0D]; null text has none. A
    null id comes after all others, rows that share an id are ordered by a
    digest of their texts, and rows equal in both are one document that stands
    there several times: each gets the result of the first. Documents shorter
    than ``window`` lose nothing. Only ``doc_id`` and ``text`` are read; an
    empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("digest", F.xxhash64("text"))
    runs = repeats(source, window, gram, slice_words).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    runs = runs.withColumnsRenamed({"doc_id": "of", "digest": "of_digest"})
    rows = source.join(runs, source["doc_id"].eqNullSafe(runs["of"]) & (source["digest"] == runs["of_digest"]), "left").select("doc_id", "text", "runs")

    def keep(batches):
        for batch in batches:
            n_words, n_removed, sums, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                words = text.as_py().encode().split()
                stays = np.ones(len(words), bool)
                for run in found or ():
                    stays[run["start"]:run["start"] + run["n"] + window - 1] = False
                rest = b" ".join([words[k] for k in np.flatnonzero(stays).tolist()] if found else words)
                n_words.append(len(words))
                n_removed.append(int(len(words) - stays.sum()))
                sums.append(hashlib.sha256(rest).hexdigest())
                kept += [rest.decode()] * keep_text
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string())] + [pa.array(kept, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][:len(cols)])

    return rows.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
