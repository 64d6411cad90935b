"""Merkle manifest of a table: one tree per language, one tree over their roots.

Digests climb and proofs descend by time-forward processing. Every node has a
label, in post-order, so that a node's label is above its children's. Going up,
the nodes are visited by ascending label; each sends its digest, through a
priority queue ordered by the receiver's label, to its parent. The reversed
sweep visits them by descending label, and each sends its children the proof
suffix that they share, with the child's siblings before it.

The queue is an external one in two parts. Messages that stay in a block, a
subtree of ``2 ** levels`` leaves at most, wait in a heap of a few entries per
level. Messages that leave it are rows of a written table, which Spark's
external sort hands to the tasks of the next round in the order of their labels.
So a tree of any size is spread over tasks by block, a round climbs ``levels``
levels, and a lost executor repeats blocks of one round.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, write_shared
from .ordering import placed

#: Levels that a round climbs: a block has 4096 leaves at most.
LEVELS = 12


def combined(digests: list[bytes]) -> bytes:
    """The digest of a run of digests: sha256 of their hex texts."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(size: int) -> int:
    """How often ``size`` nodes are paired until one remains."""
    return max(0, size - 1).bit_length()


def label(level: int, index: int) -> int:
    """Post-order label of a node: the last leaf that could be below it, then its level."""
    return (((index + 1) << level) - 1) << 6 | level


def sweep_up(leaves: list[bytes], levels: int) -> dict[tuple[int, int], list[bytes]]:
    """Digests of every node's children, by (level, index); the block's root is the one entry of level ``levels`` + 1."""
    queue: list[tuple[int, int, int, bytes]] = []  # (label, level, index, a child's digest), first label first
    children: dict[tuple[int, int], list[bytes]] = {}

    def send(level: int, index: int, digest: bytes) -> None:
        if level < levels:
            heapq.heappush(queue, (label(level + 1, index >> 1), index, level + 1, digest))
        else:
            children[level + 1, index >> 1] = [digest]

    def visit(before: float) -> None:
        while queue and queue[0][0] < before:
            to, child, level, digest = heapq.heappop(queue)
            got = [digest]
            while queue and queue[0][0] == to:
                got.append(heapq.heappop(queue)[3])
            children[level, child >> 1] = got
            send(level, child >> 1, combined(got))

    for i, digest in enumerate(leaves):
        visit(label(0, i))
        send(0, i, digest)
    visit(float("inf"))
    return children


def sweep_down(children: dict[tuple[int, int], list[bytes]], levels: int, suffix: bytes) -> Iterator[tuple[int, bytes]]:
    """(leaf index, its proof), last leaf first. ``suffix``: the proof of the block's root.

    A proof has a step for each level: ``0`` no sibling, ``L`` or ``R`` and the
    digest of a sibling to the left or right.
    """
    queue = [(-label(levels, 0), levels, 0, suffix)]
    while queue:
        _, level, index, suffix = heapq.heappop(queue)
        if not level:
            yield index, suffix
            continue
        digests = children[level, index]
        for k in range(len(digests)):
            step = b"0" if len(digests) == 1 else b"R" + digests[1] if k == 0 else b"L" + digests[0]
            child = 2 * index + k
            heapq.heappush(queue, (-label(level - 1, child), level - 1, child, step + suffix))


def steps(proof: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while at < len(proof):
        side = chr(proof[at])
        n = 0 if side == "0" else 32
        yield side, proof[at + 1:at + 1 + n]
        at += 1 + n


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    digest = leaf
    for side, sibling in steps(proof):
        digest = combined([digest] if side == "0" else [sibling, digest] if side == "L" else [digest, sibling])
    return digest


def proof_digest(proof: bytes) -> bytes:
    return combined([sibling for side, sibling in steps(proof) if side != "0"])


def _blocks(batches: Iterator[pa.RecordBatch], keys: tuple[str, str] = ("tree", "block")) -> Iterator[list[dict]]:
    """The rows of each block; blocks come one after the other, in order of place."""
    held: list[dict] = []
    of = None
    for batch in batches:
        for row in batch.to_pylist():
            this = tuple(row[k] for k in keys)
            if this != of and held:
                yield held
                held = []
            of = this
            held.append(row)
    if held:
        yield held


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _block(levels: int) -> Column:
    return F.shiftright("place", levels).alias("block")


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of nodes ``tree, place, digest, size``, from the given ones to one root for each tree, which has place 0."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    rounds = [nodes]

    def up(batches):
        for rows in _blocks(batches):
            size = rows[0]["size"]
            n = min(levels, height(size))
            (root,) = sweep_up([r["digest"] for r in rows], n)[n + 1, 0]
            yield pa.RecordBatch.from_pylist([{"tree": rows[0]["tree"], "place": rows[0]["block"], "digest": root, "size": max(1, -(-size >> levels))}],
                                             schema=pa.schema([("tree", pa.string()), ("place", pa.int64()), ("digest", pa.binary()), ("size", pa.int64())]))

    for _ in range(max(1, -(-height(largest) // levels))):
        dealt = _by_block(rounds[-1].select("tree", "place", "digest", "size", _block(levels)))
        rounds.append(write_shared(dealt.mapInArrow(up, "tree string, place long, digest binary, size long"), "merkle-up"))
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame, payload: list[str], levels: int = LEVELS) -> DataFrame:
    """Proofs of the first round's nodes: ``tree, place, digest, proof, carried`` and the ``payload`` columns of that round.

    ``above`` has ``tree, place, proof, carried`` for the last round's nodes: the
    proofs of the trees' roots, and binary values that every node below gets.
    """
    for k in reversed(range(len(rounds) - 1)):
        more = payload if k == 0 else []
        members = rounds[k].select("tree", "place", "digest", "size", *more, _block(levels))
        headers = above.select("tree", F.lit(-1).cast("long").alias("place"), "proof", "carried", F.col("place").alias("block"))
        dealt = _by_block(members.unionByName(headers, allowMissingColumns=True))
        kinds = dict(members.dtypes)
        schema = "tree string, place long, digest binary, proof binary, carried binary" + "".join(f", `{c}` {kinds[c]}" for c in more)

        def down(batches, more=more):
            for rows in _blocks(batches):
                head, leaves = rows[0], rows[1:]
                n = min(levels, height(leaves[0]["size"]))
                proofs = dict(sweep_down(sweep_up([r["digest"] for r in leaves], n), n, head["proof"]))
                out = {"tree": [r["tree"] for r in leaves], "place": [r["place"] for r in leaves], "digest": [r["digest"] for r in leaves],
                       "proof": [proofs[i] for i in range(len(leaves))], "carried": [head["carried"]] * len(leaves)}
                yield pa.RecordBatch.from_pydict(out | {c: pa.array([r[c] for r in leaves], _ARROW[kinds[c]]) for c in more})

        above = dealt.mapInArrow(down, schema)
        if k:
            above = write_shared(above, "merkle-down")
    return above


_ARROW = {"bigint": pa.int64(), "binary": pa.binary()}


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """A row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, digests as hex text.

    Leaves stand in their language's tree by ascending ``doc_id``, no id first,
    rows of equal id by digest. A null language has a tree of its own, the
    first. Any field may be null, and equal rows are leaves of their own. Where
    ``tampered`` (a condition on ``docs``) holds, the proof is tried on the
    document with one character more in ``n_chars``, unless that is null or no number.
    ``n_chars`` is a field like the others and is not recomputed. An empty
    table gives no rows. Columns other than the five fields are not read.
    """
    prepare(docs.sparkSession)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = list(fields)
    changed[3] = F.col("n_chars").try_cast("decimal(38,0)") + 1
    tried = F.when((F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))) & changed[3].isNotNull(), leaf_digest(*changed))
    # only small rows are sorted: the texts are read once, and not shuffled
    leaves = write_shared(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(*fields).alias("digest"), tried.alias("tried"), F.monotonically_increasing_id().alias("deal")), "merkle-leaves")
    nodes = write_shared(placed(leaves, [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("deal")], "tree", "merkle-placed").drop("deal"), "merkle-nodes")
    rounds = climb(nodes, levels)
    subroots = rounds[-1].select("tree", "digest")
    tops = climb(placed(subroots.select(F.lit("").alias("top"), "tree", "digest"), [F.col("tree")], "top", "merkle-tops")
                 .select(F.col("top").alias("tree"), "place", "digest", "size", F.col("tree").alias("of")), levels)
    # carried down: the root to every subroot, then subroot and root to every leaf
    roots = tops[-1].select("tree", "place", F.lit(b"").alias("proof"), F.col("digest").alias("carried"))
    top = descend(tops, roots, [], levels).select(F.col("place").alias("__at"), "proof", "carried", "digest")
    named = tops[0].select(F.col("place").alias("__at"), F.col("of").alias("tree"))
    above = named.join(top, "__at").select("tree", F.lit(0).cast("long").alias("place"), "proof", F.concat("digest", "carried").alias("carried"))

    def verify(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                subroot, root = r["carried"][:32], r["carried"][32:]
                folded = fold(r["tried"] or r["digest"], r["proof"])
                out.append((r["doc_id"], r["digest"].hex(), subroot.hex(), root.hex(), proof_digest(r["proof"]).hex(), folded.hex(), folded == root))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], _NAMES)

    return descend(rounds, above, ["doc_id", "tried"], levels).mapInArrow(
        verify, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


_NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
