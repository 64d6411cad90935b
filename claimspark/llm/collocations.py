"""Phrase collocations, mined from sorted count streams.

Counting. Four reads of the texts, each combining in its tasks: words; then
cells of word pairs, to know which pairs can be frequent; then cells of three
words whose pairs can be; then phrases of 2 to ``longest`` words whose parts
can be. A phrase is frequent only if all its parts are. What a task must know of them is a bit per cell in a filter of
``FILTER_BITS``, whatever the size of the corpus: a wrong bit lets more phrases be
counted, none fewer, and all that is kept is counted exactly.

Estimation. The counts, with the number of a language's words as the count of
its empty phrase, are kept as one stream in prefix order (words compared from
the first on) and one in suffix order (from the last on). In prefix order a
phrase comes after its beginnings, which a stack holds, so one pass merges every
phrase with the counts of its first parts and every beginning with those of its
right extensions; in suffix order the same pass merges the counts of last parts
and left extensions. No stream is hashed. Tasks take ranges of a stream: a range
gets the beginnings of its first phrase beside its own rows (at most
``longest`` of them), so that a word with any number of phrases is spread over
tasks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, mix, prepare, write_shared
from .ordering import placed

#: What ends a piece, as bytes of lower-case UTF-8, and a byte that UTF-8 doesn't use.
ENDS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
_TO_END = bytes.maketrans(ENDS, END * len(ENDS))
#: Bits of a filter, a power of two.
FILTER_BITS = 1 << 27
#: Words of the longest phrases that have a filter: longer ones are counted where all their parts of so many words may be frequent.
FILTERED = 3
#: Partitions of the input that a task of the last count reads, where that leaves as many tasks as cores.
SCANS = 8
#: Bits of a row of Spark's bitmap functions (fixed there).
_ROW_BITS = 32768
#: Bytes of text that a task takes apart at once, words that it combines at once, and words that it remembers.
SLICE, RUN, REMEMBERED = 2_000_000, 1_000_000, 400_000


def slices(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words and piece ends) of the texts of a batch, in slices of about ``SLICE`` bytes, cut at piece ends."""
    texts, by_lang = batch.column(1).cast(pa.binary()), defaultdict(list)
    for i, lang in enumerate(batch.column(0).to_pylist()):
        by_lang[lang].append(i)
    for lang, members in by_lang.items():
        held, size = [], 0
        for i in members:
            text = texts[i].as_py().lower().translate(_TO_END)
            at = 0
            while at < len(text):  # a very long text goes in several slices
                to = len(text) if len(text) - at <= SLICE else (text.find(END, at + SLICE) + 1 or len(text))
                held.append(text[at:to])
                size += to - at
                at = to
                if size >= SLICE:
                    yield lang, END.join(held).replace(END, b" \xff ").split()
                    held, size = [], 0
        if held:
            yield lang, END.join(held).replace(END, b" \xff ").split()


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


_COUNTS = "lang string, phrase string, n long"


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of all words of a language as its empty phrase."""
    hold("collocations")
    held: dict[str, Counter] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            yield _rows(lang, pa.array(counts.keys(), pa.binary()), np.fromiter(counts.values(), np.int64, len(counts)))
        held.clear()

    for batch in batches:
        for lang, words in slices(batch):
            counts = held.setdefault(lang, Counter())
            counts.update(words)
            counts[b""] += len(words) - counts.pop(END, 0)
            if sum(map(len, held.values())) > REMEMBERED:
                yield from give()
    yield from give()


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


class Ids(dict):
    """Word -> number from 1 on for words that a filter lets through, else 0; ``hashes[number]``."""

    def __init__(self, lang: str, bits: np.ndarray):
        super().__init__({END: 0})
        self.seed, self.bits, self.hashes, self.words = _seed(lang), bits, [0], [b""]

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        cell = h & (len(self.bits) * 8 - 1)
        n = 0
        if self.bits[cell >> 3] >> (cell & 7) & 1:
            n = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
        self[word] = n
        return n


def _runs(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[tuple[str, Ids, np.ndarray]]:
    """(language, ids, numbers of its words, 0 at piece ends) for about ``RUN`` words at once, or what a task has of a language."""
    hold("collocations")
    known: dict[str, Ids] = {}
    held: dict[str, list[np.ndarray]] = {}

    def give(lang: str) -> tuple[str, Ids, np.ndarray]:
        return lang, known[lang], np.concatenate(held.pop(lang)).astype(np.int64)

    for batch in batches:
        for lang, words in slices(batch):
            ids = known.get(lang) or known.setdefault(lang, Ids(lang, bits))
            numbers = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
            held.setdefault(lang, []).extend([numbers, np.zeros(1, np.int32)])
            if sum(map(len, held[lang])) > RUN:
                yield give(lang)
            if sum(map(len, known.values())) > REMEMBERED:
                for other in list(held):
                    yield give(other)
                known.clear()
    for lang in list(held):
        yield give(lang)


def _pairs(ids: Ids, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two numbered words begin, ascending, and the hash of each such pair."""
    starts = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
    return starts, _longer(np.array(ids.hashes, np.uint64)[numbers[starts]], ids, numbers[starts + 1])


def _longer(hashes: np.ndarray, ids: Ids, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases that one word more is added to."""
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + np.array(ids.hashes, np.uint64)[last])


def _through(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter lets them through."""
    cells = (hashes & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).astype(bool)


def _both(starts: np.ndarray) -> np.ndarray:
    """Which of the phrases that begin at ``starts`` have the next one, a word later, there too: both parts of a phrase one word longer."""
    return np.flatnonzero(starts[1:] == starts[:-1] + 1)


def count_cells(batches: Iterator[pa.RecordBatch], word_bits: np.ndarray, filters: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of the cells of phrases whose words and shorter phrases may all be frequent, packed by filter row (``row, cells``).

    ``filters``: of pairs, of three words, ...; the phrases counted are one word longer than the last.
    ``cells``: the places of the cells in the row (16 bits each), then their counts (32 bits each).
    """
    for _, ids, numbers in _runs(batches, word_bits):
        starts, hashes = _pairs(ids, numbers)
        for k, f in enumerate(filters, 3):
            kept = _through(f, hashes)
            starts, hashes = starts[kept], hashes[kept]
            more = _both(starts)
            starts, hashes = starts[more], _longer(hashes[more], ids, numbers[starts[more] + k - 1])
        cells, counts = np.unique((hashes & np.uint64(bits - 1)).astype(np.int64), return_counts=True)
        rows, at = np.unique(cells // _ROW_BITS, return_index=True)
        ends = [*at[1:], len(cells)]
        places, counts = (cells % _ROW_BITS).astype("<u2"), counts.astype("<u4")
        packed = [places[i:j].tobytes() + counts[i:j].tobytes() for i, j in zip(at, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(packed, pa.binary())], ["row", "cells"])


def frequent_cells(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The filter rows with a bit for every cell counted ``least`` times or more; the rows come sorted, one is held at a time."""
    of, held = None, None

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())], ["row", "bits"])

    for batch in batches:
        for row, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
            if row != of:
                if held is not None:
                    yield give()
                of, held = row, np.zeros(_ROW_BITS, np.int64)
            data = cells.as_py()
            n = len(data) // 6
            held[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, "<u4", n, 2 * n)
    if held is not None:
        yield give()


def count_phrases(batches: Iterator[pa.RecordBatch], word_bits: np.ndarray, filters: list[np.ndarray], longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of phrases of 2 to ``longest`` words that the filters (of pairs, of three words, ...) let through with all their parts."""
    for lang, ids, numbers in _runs(batches, word_bits):
        starts, hashes = _pairs(ids, numbers)
        first = numbers[starts]  # a phrase is numbered by its first words' number and its last word
        words = pa.array(ids.words, pa.binary())
        for k in range(2, longest + 1):
            if k > 2:
                more = _both(starts)
                starts, first = starts[more], first[more]
                hashes = _longer(hashes[more], ids, numbers[starts + k - 1])
            if k - 2 < len(filters):
                kept = _through(filters[k - 2], hashes)
                starts, first, hashes = starts[kept], first[kept], hashes[kept]
            if not len(starts):
                break
            _, at, first, counts = np.unique(first << 32 | numbers[starts + k - 1], return_index=True, return_inverse=True, return_counts=True)
            places = starts[at]
            yield _rows(lang, pc.binary_join_element_wise(*[words.take(pa.array(numbers[places + j])) for j in range(k)], b" "), counts)


def combined(batches: Iterator[pa.RecordBatch], most: int = RUN) -> Iterator[pa.RecordBatch]:
    """The rows of ``lang, phrase, n``, summed by phrase over a whole task unless more than half of ``most`` rows are left of ``most``."""
    held: list[pa.RecordBatch] = []

    def summed() -> list[pa.RecordBatch]:
        return pa.Table.from_batches(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"]).to_batches()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > most:
            held = summed()
            if sum(b.num_rows for b in held) > most // 2:
                yield from held
                held = []
    if held:
        yield from summed()


def gathered(rows: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits from its rows ``row, bits``: of a fixed size, whatever the corpus."""
    out = np.zeros(max(bits, _ROW_BITS) // 8, np.uint8)
    for r in rows.collect():  # bits / 32768 rows of 4 KB at most
        out[r["row"] * 4096:(r["row"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out[:bits // 8]


def _word_cells(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [xxhash.xxh3_64_intdigest(w, _seed(lang)) & (bits - 1) for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64())], ["cell"])


def frequent(docs: DataFrame, least: int, longest: int, bits: int = FILTER_BITS) -> DataFrame:
    """``lang, phrase, n`` of all phrases of 1 to ``longest`` words that occur ``least`` times or more; the empty phrase counts all words."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def summed(rows: DataFrame, *by: str) -> DataFrame:
        # tasks have combined their rows already; most keys are rare, and a second map-side table of them would only take memory
        return rows.repartition(*by).groupBy(*by).agg(F.sum("n").alias("n"))

    words = write_shared(summed(texts.mapInArrow(count_words, _COUNTS), "lang", "phrase").filter((F.col("n") >= least) | (F.col("phrase") == "")), "words")
    cells = words.filter("phrase <> ''").select("lang", "phrase").mapInArrow(lambda b: _word_cells(b, bits), "cell long")
    rows = cells.groupBy(F.shiftright("cell", 15).alias("row")).agg(F.expr(f"bitmap_construct_agg(cell & {_ROW_BITS - 1})").alias("bits"))
    word_bits = spark.sparkContext.broadcast(gathered(rows, bits))
    filters: list[Broadcast] = []
    for _ in range(2, min(longest, FILTERED) + 1):
        cells = texts.mapInArrow(lambda b, held=tuple(filters): count_cells(b, word_bits.value, [f.value for f in held], bits), "row long, cells binary")
        rows = cells.repartition("row").sortWithinPartitions("row").mapInArrow(lambda b: frequent_cells(b, least), "row long, bits binary")
        filters.append(spark.sparkContext.broadcast(gathered(rows, bits)))
    # nearly every task meets nearly every frequent phrase, so the counts that tasks give grow with tasks times phrases: fewer and longer tasks
    tasks = max(spark.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // SCANS))
    phrases = texts.coalesce(tasks).mapInArrow(lambda b: combined(count_phrases(b, word_bits.value, [f.value for f in filters], longest)), _COUNTS)
    return write_shared(words.unionByName(summed(phrases, "lang", "phrase").filter(F.col("n") >= least)), "counts")


def stream(counts: DataFrame, what: str) -> DataFrame:
    """``lang, path, n, sides`` in order of path, dealt by ranges (``part``), each with the beginnings of its first path as headers."""
    dealt = counts.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    own = write_shared(dealt.select("lang", "path", "n", "sides", F.spark_partition_id().cast("long").alias("part")), what)
    first = own.groupBy("part").agg(F.min(F.struct("lang", "path")).alias("first"))
    wanted = first.filter(F.size("first.path") > 0).select("part", "first.lang", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("first.path") - 1), lambda k: F.slice("first.path", F.lit(1), k))).alias("path"))
    headers = wanted.join(own.drop("part"), ["lang", "path"]).withColumn("header", F.lit(True))
    both = own.withColumn("header", F.lit(False)).unionByName(headers)
    return both.select("part", "lang", "path", "n", "sides", "header").repartition("part").sortWithinPartitions("part", "lang", "path")


def merged(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[tuple[list[dict], list[dict]]]:
    """One pass over a stream: (rows with the counts of their beginnings, ``found`` [n of the empty path, then of each], covered paths).

    A path is covered if a path that has one step more occurs at least ``share``
    hundredths as often.
    """
    stack: list[dict] = []
    for batch in batches:
        rows, covered = [], []
        for row in batch.to_pylist():
            path = row["path"]
            while stack and (stack[-1]["lang"] != row["lang"] or stack[-1]["part"] != row["part"] or stack[-1]["path"] != path[:len(stack[-1]["path"])]):
                stack.pop()
            if len(stack) != len(path):
                raise ValueError(f"the stream misses a beginning of {path!r}")
            if stack and not stack[-1].get("covered") and 100 * row["n"] >= share * stack[-1]["n"]:
                stack[-1]["covered"] = True
                covered.append(stack[-1])
            if not row["header"]:
                rows.append(row | {"found": [s["n"] for s in stack]})
            stack.append(row)
        yield rows, covered


def best_cut(a: int, n: int, lefts: list[int], rights: list[int]) -> tuple[int, int, int, int]:
    """(score, words of the first part, its count, the rest's count) of the lowest-scoring cut, the first of equals.

    ``lefts``: counts of the first 1, 2, ... words; ``rights``: of the last 1, 2, ... words.
    """
    m = len(lefts) + 1
    return min((1000 * a * n // (lefts[k - 1] * rights[m - k - 1]), k, lefts[k - 1], rights[m - k - 1]) for k in range(1, m))


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000, bits: int = FILTER_BITS) -> DataFrame:
    """Each language's best phrases of 2 to ``longest`` words: ``lang, rank, phrase, a, l, r, n, score`` and ``cut``.

    A null language is ``und``; a null text is empty, and a text without words
    adds nothing, so an empty table gives no rows. Repeated rows count as often
    as they occur. ``a``: occurrences of the phrase, ``least`` or more; ``n``:
    all words of the language; ``l``, ``r``: occurrences of the first ``cut``
    words and of the rest, at the cut with the least ``score`` = floor(1000 a n
    / (l r)) (ties: the least cut). A phrase that stands in a longer one that
    occurs ``share`` hundredths as often or more is left out. Order: score, then
    ``a``, descending, then phrase. Python integers keep products exact. Only
    ``lang`` and ``text`` are read.

    As a phrase in between occurs no less often than the longer one, it is
    enough to look at extensions by one word.
    """
    counts = frequent(docs, least, longest, bits)
    words = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    first = stream(counts.select("lang", words.alias("path"), "n", F.array().cast("array<long>").alias("sides")), "prefix-order")
    kinds = pa.schema([("lang", pa.string()), ("path", pa.list_(pa.string())), ("n", pa.int64()), ("sides", pa.list_(pa.int64())), ("covered", pa.bool_())])

    def forward(batches):
        for rows, covered in merged(batches, share):
            out = [{"lang": r["lang"], "path": r["path"][::-1], "n": r["n"], "sides": r["found"], "covered": False} for r in rows]
            out += [{"lang": r["lang"], "path": r["path"][::-1], "n": r["n"], "sides": [], "covered": True} for r in covered]
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    once = write_shared(first.mapInArrow(forward, "lang string, path array<string>, n long, sides array<long>, covered boolean"), "prefix-merged")
    second = stream(once.filter("NOT covered").drop("covered"), "suffix-order")
    names = ["lang", "phrase", "a", "l", "r", "n", "score", "cut", "covered"]

    def backward(batches):
        for rows, covered in merged(batches, share):
            out = []
            for r in rows:
                if len(r["path"]) > 1:
                    n, lefts = r["sides"][0], r["sides"][1:]
                    score, k, left, right = best_cut(r["n"], n, lefts, r["found"][1:])
                    out.append((r["lang"], " ".join(r["path"][::-1]), r["n"], left, right, n, score, k, False))
            out += [(r["lang"], " ".join(r["path"][::-1]), r["n"], 0, 0, 0, 0, 0, True) for r in covered]
            types = [pa.string(), pa.string(), *[pa.int64()] * 6, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, types)], names)

    twice = write_shared(second.mapInArrow(backward, "lang string, phrase string, a long, l long, r long, n long, score long, cut long, covered boolean"), "suffix-merged")
    covered = (twice.filter("covered").select("lang", "phrase")
               .unionByName(once.filter("covered").select("lang", F.array_join(F.reverse("path"), " ").alias("phrase"))))
    kept = twice.filter("NOT covered").drop("covered").join(covered.hint("merge"), ["lang", "phrase"], "left_anti")
    order = placed(kept, [F.desc("score"), F.desc("a"), F.col("phrase")], "lang", "collocations")
    return order.filter(F.col("place") < top).select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
