"""Jaccard self-join of documents on word n-grams, by grouped prefixes.

Two sets of Jaccard similarity t or more share one of the first
n - ceil(t * n) + 1 members of each, under any one order of all members. The
order here puts rare members first, so that hardly any unrelated documents share
a prefix:

* Counts need not cover all members. Members whose hash starts with two zero
  bits (with one, where the threshold is low and prefixes are long) come first
  in the order, by how many different sets hold them; a set emits only these
  (about a quarter, or half), unless they are too few to hold its prefix; then
  it emits all.
* A set whose prefix has only members that no other set emitted has no partner.
  The sets that share prefix members are joined to families (connected
  components over prefix members; links between members' smallest holders, not
  pairs of sets).
* Equal sets are one node from the start, whatever their number of documents.
* Within a family, sets with identical prefixes and size form a group; group
  pairs that share a prefix member are filtered by size and position, then
  expanded and verified on whole sets. Pairs already known to be connected are
  not verified again, so that a dense cluster costs no square of its size. A
  family too large for a task is split into blocks, and each pair of blocks is
  verified by a task of bounded size.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, mix, word_hashes, write_shared
from .components import components

#: Members of all sets that one task verifies at most, twice.
FAMILY_MEMBERS = 2_000_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different ``width``-word shingles; fewer words are one shingle.

    A-Z are lower-cased; words are runs without white space [\\x20\\x09-\\x0D].
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    size = min(width, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k]
    return np.unique(mix(total))


def node_of(members: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash of its members."""
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def prefix_length(n, percent: int):
    """n - ceil(percent / 100 * n) + 1, for numbers or arrays."""
    return n + (-n * percent) // 100 + 1


def counted_bits(percent: int) -> int:
    """Members below 2 to this power are counted first: a quarter of all if prefixes mostly fit in it, else half."""
    return 62 if 1.6 * (100 - percent) <= 25 else 63


def _emitted(members: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The members that a set emits, and how many of them are in the counted part."""
    counted = int(np.searchsorted(members, np.uint64(1 << counted_bits(percent))))
    if counted >= 1.6 * prefix_length(len(members), percent) + 4:
        return members[:counted], counted
    return members, counted


def sets_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, digest, n, node, counted, members`` of every document; equal sets of one task emit members once."""
    def run(batches):
        hold("words")
        seen = set()
        for batch in batches:
            sizes, nodes, counts, lists = [], [], [], []
            for text in batch.column(1):
                members = shingles(text.as_py(), width)
                node, emitted, counted = None, members[:0], 0
                if len(members):
                    node = node_of(members)
                    if node not in seen:
                        seen.add(node)
                        emitted, counted = _emitted(members, percent)
                sizes.append(len(members))
                nodes.append(node)
                counts.append(counted)
                lists.append(emitted.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            flat = np.concatenate([np.empty(0, np.int64), *lists])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["doc_id", "digest", "n", "node", "counted", "members"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("digest", F.xxhash64("text"))
    return source.mapInArrow(run, "doc_id long, digest long, n long, node long, counted long, members array<long>")


def shared_prefixes(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``node, member``: prefix members that another set emitted too."""
    emitted = sets.filter("size(members) > 0").select("node", F.explode("members").alias("member"))
    holders = emitted.repartition("member").dropDuplicates(["member", "node"])
    counted = holders.withColumn("held", F.count("*").over(Window.partitionBy("member"))).filter("held > 1")
    late = (F.shiftrightunsigned("member", counted_bits(percent)) != 0).cast("int")
    mine = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(late.alias("late"), "held", "member"))).alias("common"))
    first, last = F.filter("common", lambda m: m["late"] == 0), F.filter("common", lambda m: m["late"] == 1)
    rows = mine.join(nodes, "node").select("node", "emitted", "counted", first.alias("first"), last.alias("last"),
                                           (F.col("n") + F.floor(-F.col("n") * percent / F.lit(100)) + 1).alias("p"))
    # the order: counted members by holders (one holder first), then the others likewise
    room = F.col("p") - (F.col("counted") - F.size("first"))
    take = F.greatest(F.lit(0), F.least(room, F.size("first"))).cast("int")
    room_late = room - F.size("first") - (F.col("emitted") - F.col("counted") - F.size("last"))
    take_late = F.greatest(F.lit(0), F.least(room_late, F.size("last"))).cast("int")
    prefix = F.concat(F.slice("first", F.lit(1), take), F.slice("last", F.lit(1), take_late))
    return rows.select("node", F.explode(prefix).alias("m")).select("node", "m.member")


def verified_links(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Grouped prefix join of some sets: links that connect whatever is connected by similar pairs."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    member, count = np.unique(np.concatenate(sets), return_counts=True)
    groups: dict[tuple, list[int]] = defaultdict(list)
    for k, s in enumerate(sets):
        order = np.lexsort((s, count[np.searchsorted(member, s)]))[:prefix_length(len(s), percent)]
        groups[len(s), s[order].tobytes()].append(k)
    links: list[tuple[int, int]] = []

    def verify(x: int, y: int) -> None:
        a, b = find(x), find(y)
        if a != b:
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * shared >= percent * (len(sets[x]) + len(sets[y]) - shared):
                root[b] = a
                links.append((nodes[x], nodes[y]))

    index: dict[int, list[tuple[int, int]]] = defaultdict(list)
    done: list[tuple[int, list[int]]] = []
    for (n, key), own in sorted(groups.items()):
        prefix = np.frombuffer(key, np.uint64).tolist()
        first_seen: dict[int, bool] = {}
        for at, m in enumerate(prefix):
            for g, there in index[m]:
                size = done[g][0]
                # size, and the most that can still be shared from the first common place on
                if g not in first_seen and 100 * size >= percent * n:
                    most = min(n - at, size - there)
                    first_seen[g] = (100 + percent) * most >= percent * (n + size)
        for g, near in first_seen.items():
            if near:
                for x in own:
                    for y in done[g][1]:
                        verify(x, y)
        for k, x in enumerate(own):
            for y in own[:k]:
                verify(y, x)
        for at, m in enumerate(prefix):
            index[m].append((len(done), at))
        done.append((n, own))
    return links


def _families(entries: DataFrame) -> DataFrame:
    """``node, family`` from shared prefix members, through each member's smallest holder."""
    hubs = entries.groupBy("member").agg(F.min("node").alias("hub"))
    return components(entries.join(hubs, "member").select(F.col("node").alias("a"), F.col("hub").alias("b")))


def texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with the text of each node's first document, found by id and text digest: many documents may share the id."""
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).withColumn("digest", F.xxhash64("text"))
    found = members.join(source, members["least_id"].eqNullSafe(source["id"]) & (members["least_digest"] == source["digest"]))
    return found.select("family", "block", "blocks", "node", "text")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, family_members: int = FAMILY_MEMBERS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``, and ``component, digest`` of set and text.

    Documents link when 100 * |shared| >= percent * |union| of their shingle
    sets; ``component_id`` is the smallest id that links lead to. Documents
    without words link with nothing and get their own id; rows that share an id
    are documents of their own; a null id is not smaller than any other. Only
    ``doc_id`` and ``text`` are read. An empty table gives none.
    """
    sets = write_shared(sets_of(docs, width, percent), "sets")
    nodes = sets.filter("node IS NOT NULL").groupBy("node").agg(
        F.max("n").alias("n"), F.max(F.size("members")).alias("emitted"), F.max("counted").alias("counted"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("least"))
    nodes = nodes.withColumns({"least_id": F.col("least.doc_id"), "least_digest": F.col("least.digest")}).drop("least")
    entries = write_shared(shared_prefixes(sets, nodes, percent), "entries")
    families = write_shared(_families(entries), "families")

    sizes = families.join(nodes.select("node", "n"), "node").groupBy("component").agg(F.ceil(F.sum("n") / family_members).alias("blocks"))
    members = families.join(nodes.select("node", "least_id", "least_digest"), "node").join(sizes, "component")
    block = F.pmod("node", "blocks")
    members = members.select("node", "least_id", "least_digest", F.col("component").alias("family"), block.alias("block"), "blocks")
    texts = texts_of(docs, members)

    def whole_sets(batches):
        for batch in batches:
            found, mine = [], []
            for k, (node, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4))):
                s = shingles(text.as_py(), width)
                if len(s) and node_of(s) == node:  # not another text with the same digest
                    found.append(s.tobytes())
                    mine.append(k)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(mine, pa.int64())) for c in range(4)), pa.array(found, pa.binary())], ["family", "block", "blocks", "node", "members"])

    rows = texts.mapInArrow(whole_sets, "family long, block long, blocks long, node long, members binary")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "block").alias("i"), F.greatest(b, "block").alias("j")))
    rows = rows.select("family", "node", "members", F.explode(pairs).alias("pair")).select("family", "pair.i", "pair.j", "node", "members")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        links = verified_links(group["node"].tolist(), [np.frombuffer(m, np.uint64) for m in group["members"]], percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    links = write_shared(rows.groupBy("family", "i", "j").applyInPandas(link, "a long, b long"), "links")
    found = components(links).select(F.col("node").alias("of"), "component")
    named = nodes.select("node", "least_id").join(found, F.col("node") == F.col("of"), "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    names = named.join(least, "component").select(F.col("node").alias("of"), "component_id", "component")
    return sets.select("doc_id", "digest", "n", "node").join(names, F.col("node") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component", "digest")


def keep_one(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``docs``, all columns, with one row of each component: the smallest id's (then the smallest text digest's).

    Rows without words all stay.
    """
    rows = write_shared(jaccard_components(docs, width, percent), "components")
    first = rows.filter("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")).alias("first"))
    kept = first.select("first.doc_id", "first.digest", F.lit(True).alias("words")).unionByName(
        rows.filter("component IS NULL").select("doc_id", "digest", F.lit(False).alias("words")).distinct())
    kept = kept.withColumnsRenamed({"doc_id": "of", "digest": "of_digest"})
    source = docs.select(F.struct("*").alias("doc")).select(
        "doc", F.col("doc.doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc.text").cast("string")).alias("digest"))
    found = source.join(kept, source["id"].eqNullSafe(kept["of"]) & (source["digest"] == kept["of_digest"]))
    copy = F.row_number().over(Window.partitionBy("id", "digest").orderBy("words"))
    return found.withColumn("copy", copy).filter("copy = 1 OR NOT words").select("doc.*")
