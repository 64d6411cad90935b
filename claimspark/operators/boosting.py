"""Boosted trees on Spark, grown as MLlib grows them and on in steps (ML-1).

MLlib has no warm start, and a level of a tree costs it a pass over boxed rows.
Here rows are binned once into blocks of bytes, one a partition; a task gives
the histograms of a level's nodes from NumPy, they are summed in the order of
the partitions, and the driver (nodes x features x bins, whatever the data)
takes the best splits. What is drawn (split candidates, bags, features of a
node), the order in which a block is summed, gains, stops and pruning are those
of ``GBTClassifier``, so the trees are the same. More rounds go on from the
margins that the rows have.
"""

from __future__ import annotations

import functools
import gc
import json
import math
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import ensure_checkpoint_dir

# --- MLlib's random numbers --------------------------------------------------

_M32, _M64 = (1 << 32) - 1, (1 << 64) - 1
#: Draws of a lane: a stream is cut into lanes, which advance side by side.
LANE = 256


def _murmur3(data: bytes, seed: int) -> int:
    """scala.util.hashing.MurmurHash3.bytesHash of whole words."""
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & _M32
        k = (k << 15 | k >> 17) & _M32
        h ^= k * 0x1B873593 & _M32
        h = (h << 13 | h >> 19) & _M32
        h = (h * 5 + 0xE6546B64) & _M32
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & _M32
    return h ^ h >> 16


def xorshift_state(seed: int) -> int:
    """The first state of Spark's XORShiftRandom(seed)."""
    data = (seed & _M64).to_bytes(8, "big")
    low = _murmur3(data, 0x3C074A61)
    return _murmur3(data, low) << 32 | low


def _step(s: np.ndarray) -> np.ndarray:
    s = s ^ s << np.uint64(21)
    s = s ^ s >> np.uint64(35)
    return s ^ s << np.uint64(4)


def _times(matrix: np.ndarray, s: np.ndarray) -> np.ndarray:
    """States after a linear map over bits; ``matrix[b]``: what becomes of bit b."""
    out = np.zeros_like(s)
    for b in range(64):
        out ^= matrix[b] * (s >> np.uint64(b) & np.uint64(1))
    return out


@functools.cache
def _jumps() -> tuple[np.ndarray, ...]:
    """Maps that are 1, 2, 4, ... lanes of steps."""
    one = _step(np.uint64(1) << np.arange(64, dtype=np.uint64))
    for _ in range(LANE.bit_length() - 1):
        one = _times(one, one)
    out = [one]
    for _ in range(31):
        out.append(_times(out[-1], out[-1]))
    return tuple(out)


def uniforms(seed: int, n: int) -> np.ndarray:
    """The first ``n`` doubles of XORShiftRandom(seed)."""
    lanes = -(-2 * n // LANE)
    s = np.array([xorshift_state(seed)], dtype=np.uint64)
    for jump in _jumps():
        if len(s) >= lanes:
            break
        s = np.concatenate([s, _times(jump, s)])
    s = s[:lanes]
    out = np.empty((LANE, lanes), dtype=np.uint64)
    for i in range(LANE):
        out[i] = s = _step(s)
    high, low = out[0::2] & np.uint64((1 << 26) - 1), out[1::2] & np.uint64((1 << 27) - 1)
    return (((high << np.uint64(27)) + low).astype(np.float64) * 2.0 ** -53).T.ravel()[:n]


class JavaRandom:
    """java.util.Random"""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        v = self.state >> 16
        return v - (1 << 32) if v >> 31 else v

    def next_long(self) -> int:
        return ((self._next() << 32) + self._next()) & _M64


def reservoir(n: int, k: int, seed: int) -> list[int]:
    """SamplingUtils.reservoirSampleAndCount of 0 .. n-1."""
    out, s = list(range(min(k, n))), xorshift_state(seed)

    def drawn(bits: int) -> int:
        nonlocal s
        s ^= s << 21 & _M64
        s ^= s >> 35
        s ^= s << 4 & _M64
        return s & (1 << bits) - 1

    for i in range(k, n):
        u = ((drawn(26) << 27) + drawn(27)) * 2.0 ** -53
        if (at := int(u * (i + 1))) < k:
            out[at] = i
    return out


# --- blocks of rows ------------------------------------------------------------

@dataclass
class Block:
    """A partition's rows: bins by feature, label (-1, 1), weight, margin of the trees so far."""
    part: int
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    margin: np.ndarray


@dataclass
class Bag:
    """The rows of a block that a round draws, with their residuals."""
    part: int
    bins: np.ndarray
    weight: np.ndarray
    y: np.ndarray


@dataclass
class Tree:
    """By heap index (root 1, children 2i and 2i+1): feature (-1: no split), last bin that goes left, output."""
    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    stats: dict        # heap index -> sums of weight, weight x y, weight x y^2
    impurity: dict
    gain: dict


def _walk(feature: np.ndarray, split: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
    n = bins.shape[1]
    flat, at = bins.ravel(), np.arange(n)
    node = np.ones(n, dtype=np.int64)
    for _ in range(levels):
        f = feature[node]
        right = flat[np.maximum(f, 0) * n + at] > split[node]
        node = np.where(f < 0, node, 2 * node + right)
    return node


def _advanced(block: Block, trees: list[tuple[Tree, float]], depth: int) -> np.ndarray:
    margin = block.margin
    for tree, weight in trees:
        margin = margin + tree.value[_walk(tree.feature, tree.split, block.bins, depth)] * weight
    return margin


@functools.cache
def _exp_table() -> tuple[np.ndarray, np.ndarray]:
    """2^(j/64) cut to 53 bits, and what is cut off as a share of it."""
    with localcontext() as c:
        c.prec = 60
        exact = [(Decimal(2).ln() * j / 64).exp() for j in range(64)]
        high = [int(t * 2 ** 52) for t in exact]
        return np.array(high) / 2.0 ** 52, np.array([float(t * 2 ** 52 / h - 1) for t, h in zip(exact, high)])


_F = float.fromhex
_64_LN2, _LN2_64, _LN2_64_LOW = _F("0x1.71547652b82fep+6"), _F("0x1.62e42fefap-7"), _F("0x1.cf79abc9e3b39p-46")
_C2, _C3, _C4, _C5, _C6 = (_F(h) for h in ("0x1.ffffffffffffep-2", "0x1.5555555548ba1p-3", "0x1.55555555b9e25p-5", "0x1.11115c090cf0fp-7", "0x1.6c15ce3289860p-10"))


def jvm_exp(x: np.ndarray) -> np.ndarray:
    """Math.exp as HotSpot computes it on x86-64, to the last bit.

    NumPy's differs in the last bit for some arguments, and that decides between
    splits which part the same rows.
    """
    if not (np.abs(x) < 700).all():
        return np.exp(x)
    high, low = _exp_table()
    m = np.rint(x * _64_LN2)
    y = x - m * _LN2_64 - m * _LN2_64_LOW
    k = m.astype(np.int64)
    j, y2 = k & 63, y * y
    y3 = y * y2
    p = y3 * (_C3 + _C4 * y) + (y + low[j] + y3 * y2 * (_C5 + _C6 * y)) + y2 * _C2
    t = np.ldexp(high[j], k >> 6)
    return p * t + t


def _residuals(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Minus the gradient of the log loss."""
    return 4.0 * label / (1.0 + jvm_exp(2.0 * label * margin))


def _bag(block: Block, trees: list[tuple[Tree, float]], depth: int, first: bool, rate: float, seed: int) -> Bag:
    y = block.label if first else _residuals(block.label, _advanced(block, trees, depth))
    if rate >= 1.0:
        return Bag(block.part, block.bins, block.weight, y)
    drawn = np.flatnonzero(uniforms(seed + block.part + 1, len(y)) < rate)
    return Bag(block.part, np.ascontiguousarray(block.bins[:, drawn]), block.weight[drawn], y[drawn])


def _histograms(bag: Bag, feature: np.ndarray, split: np.ndarray, slots: np.ndarray, level: int, wanted: list[int], sizes: np.ndarray) -> np.ndarray:
    """(3, nodes x bins of the wanted features): weight, weight x y and weight x y^2."""
    n_slots = int(slots.max()) + 1
    slot, bins, w, y = slots[_walk(feature, split, bag.bins, level)], bag.bins, bag.weight, bag.y
    if level and (slot < 0).any():
        held = np.flatnonzero(slot >= 0)
        slot, bins, w, y = slot[held], bins[:, held], w[held], y[held]
    wy = w * y
    wyy = wy * y
    out, at = np.empty((3, n_slots * int(sizes[wanted].sum()))), 0
    cell = np.empty(len(slot), dtype=np.int64)
    base = {size: slot * size for size in set(sizes[wanted].tolist())}
    for f in wanted:
        size = int(sizes[f])
        np.add(base[size], bins[f], out=cell)
        end = at + n_slots * size
        for k, of in enumerate((w, wy, wyy)):
            out[k, at:end] = np.bincount(cell, weights=of, minlength=n_slots * size)
        at = end
    return out


#: Partitions whose sums the driver adds up itself; of more, tasks add up a root's worth each first.
DIRECT_PARTS = 128


def _summed(parts: RDD, n: int) -> np.ndarray:
    """The sum of (partition, array) rows, in the order of the partitions."""
    if n > DIRECT_PARTS:
        size = math.isqrt(n - 1) + 1
        parts = (parts.map(lambda kv: (kv[0] // size, kv)).groupByKey(-(-n // size), lambda k: k)
                      .map(lambda g: (g[0], functools.reduce(np.add, [a for _, a in sorted(g[1], key=lambda kv: kv[0])]))))
    return functools.reduce(np.add, [a for _, a in sorted(parts.collect(), key=lambda kv: kv[0])])


@functools.cache
def _settled() -> None:
    """A Python worker collects its garbage after every task: what it has imported needn't be looked through each time."""
    gc.freeze()


def _impurity(w, wy, wyy):
    """Variance; 0 where nothing is."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w == 0, 0.0, (wyy - wy * wy / w) / w)


_INVALID = -np.finfo(np.float64).max
_EPSILON = 2.0 ** -52


class Growth:
    """An ensemble on ``rows`` (``model_input`` with weights) that can be grown further."""

    #: Rounds after which the rows' margins are written down; until then each round adds its trees to the last ones.
    REBASE = 5

    def __init__(self, rows: DataFrame, est: GBTClassifier, xcols: list[str], assembler):
        self.rows, self.spark = rows, rows.sparkSession
        self.trees: list[Tree] = []
        self.depth, self.rate, self.step, self.seed = est.getMaxDepth(), est.getSubsamplingRate(), est.getStepSize(), est.getSeed()
        self._candidates(assembler, est)
        self.sizes = np.array([len(t) + 1 for t in self.thresholds])
        ensure_checkpoint_dir(self.spark)
        first = _blocks(rows, self.thresholds, xcols).persist(StorageLevel.MEMORY_AND_DISK)
        first.checkpoint()  # every job would carry the plan of the rows
        self.parts = first.map(lambda b: b.part).max() + 1
        self.saved = first.getCheckpointFile()
        # a task of Python costs some 50 ms before it begins: several blocks each; they are summed one by one, so it changes nothing
        tasks = min(first.getNumPartitions(), max(8, self.spark.sparkContext.defaultParallelism))
        self.held, self.blocks = [first], first.coalesce(tasks)
        self.based = 0  # trees in the blocks' margins

    def _candidates(self, assembler, est: GBTClassifier) -> None:
        """MLlib's own candidate thresholds of every feature, from its sample of the rows, and its limits."""
        jvm, java = self.spark._jvm, est._to_java()
        single = lambda package, name: getattr(getattr(package, f"{name}$"), "MODULE$")
        spark, impl = jvm.org.apache.spark, jvm.org.apache.spark.ml.tree.impl
        instances = single(spark.ml.util, "DatasetUtils").extractInstances(java, assembler.transform(self.rows)._jdf, jvm.scala.Some(2))
        none = single(jvm.scala.collection.immutable, "Map").empty()
        algo = single(spark.mllib.tree.configuration, "Algo").Classification()
        meta = impl.DecisionTreeMetadata.buildMetadata(instances, java.getOldBoostingStrategy(none, algo).treeStrategy(), 1, est.getFeatureSubsetStrategy())
        self.thresholds = [np.array([s.threshold() for s in of]) for of in single(impl, "RandomForest").findSplits(instances, meta, est.getSeed())]
        self.n_chosen = meta.numFeaturesPerNode()
        self.min_weight, self.min_gain = meta.minWeightPerNode(), meta.minInfoGain()
        if meta.minInstancesPerNode() != 1:
            raise ValueError("a node may have one row")

    def grow(self, rounds: int) -> None:
        while len(self.trees) < rounds:
            self._round()

    def close(self) -> None:
        for rdd in self.held:
            rdd.unpersist()
        if self.saved:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.saved)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _pending(self) -> list[tuple[Tree, float]]:
        return [(self.trees[k], w) for k, w in self.weights().items() if k >= self.based]

    def _round(self) -> None:
        m, depth, rate, seed = len(self.trees), self.depth, self.rate, self.seed + len(self.trees)
        gone = []
        if m - self.based >= self.REBASE:
            gone, trees = self.held, self._pending()
            self.blocks = self.blocks.map(lambda b: Block(b.part, b.bins, b.label, b.weight, _advanced(b, trees, depth))).persist(StorageLevel.MEMORY_AND_DISK)
            self.held, self.based = [self.blocks], m
        pending = self._pending()

        def bag(b: Block) -> Bag:
            _settled()
            return _bag(b, pending, depth, not m, rate, seed)

        bags = self.blocks.map(bag).persist(StorageLevel.MEMORY_AND_DISK)
        self.trees.append(self._tree(bags, JavaRandom(seed)))
        for rdd in (bags, *gone):
            rdd.unpersist()

    def _tree(self, bags: RDD, random: JavaRandom) -> Tree:
        size, n_features, sizes = 2 << self.depth, len(self.thresholds), self.sizes
        t = Tree(np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64), np.zeros(size), {}, {}, {})
        stack, level = [1], 0
        while stack:
            chosen = {i: reservoir(n_features, self.n_chosen, random.next_long()) if self.n_chosen < n_features else list(range(n_features)) for i in stack}
            slots = np.full(size, -1, dtype=np.int64)
            slots[stack] = np.arange(len(stack))
            wanted = sorted({f for of in chosen.values() for f in of if len(self.thresholds[f])})
            feature, split, at = t.feature.copy(), t.split.copy(), level
            found = _summed(bags.map(lambda b: (b.part, _histograms(b, feature, split, slots, at, wanted, sizes))), self.parts)
            sums, start = np.zeros((3, len(stack), n_features, sizes.max())), 0
            for f in wanted:
                end = start + len(stack) * sizes[f]
                sums[:, :, f, :sizes[f]] = found[:, start:end].reshape(3, len(stack), sizes[f])
                start = end
            after: list[int] = []
            for s, i in enumerate(stack):
                for child in self._split(t, i, level, sums[:, s], chosen[i]):
                    after.insert(0, child)
            stack, level = after, level + 1
        self._pruned(t, 1)
        for i, (w, wy, _) in t.stats.items():
            t.value[i] = wy / w if w else 0.0
        return t

    def _split(self, t: Tree, i: int, level: int, sums: np.ndarray, chosen: list[int]) -> list[int]:
        """Gives node ``i`` its best split, and returns the children that may be split in turn."""
        features = [f for f in chosen if len(self.thresholds[f])]
        if not features:
            if i not in t.stats:
                t.stats[i] = (0.0, 0.0, 0.0)
            t.impurity[i] = -1.0
            return []
        below = np.cumsum(sums[:, features], axis=2)  # (3, features, bins)
        left, total = below[:, :, :-1], below[:, :, -1:]
        right = total - left
        if i not in t.stats:
            t.stats[i] = tuple(map(float, left[:, 0, 0] + right[:, 0, 0]))
        impurity = float(_impurity(*t.stats[i]))
        lost, kept = _impurity(*left), _impurity(*right)
        count = left[0] + right[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = impurity - left[0] / count * lost - right[0] / count * kept
        held = np.cumsum(sums[0, features] > 0, axis=1)  # weights are positive: bins that have rows
        held, all_held = held[:, :-1], held[:, -1:]
        valid = (held > 0) & (held < all_held) & (np.minimum(left[0], right[0]) >= self.min_weight) & (gain >= self.min_gain)
        valid &= np.arange(gain.shape[1]) < np.array([len(self.thresholds[f]) for f in features])[:, None]
        gain = np.where(valid, gain, _INVALID)
        k, at = divmod(int(np.argmax(gain)), gain.shape[1])
        best = float(gain[k, at])
        t.impurity[i] = impurity if valid[k, at] else -1.0
        if best <= 0 or level == self.depth:
            return []
        t.feature[i], t.split[i], t.gain[i] = features[k], at, best
        open_ = []
        for child, of, imp in ((2 * i, left, lost), (2 * i + 1, right, kept)):
            t.stats[child] = tuple(map(float, of[:, k, at]))
            t.impurity[child] = float(imp[k, at])
            if level + 1 < self.depth and abs(t.impurity[child]) >= _EPSILON:
                open_.append(child)
        return open_

    def _pruned(self, t: Tree, i: int) -> None:
        """A split both of whose sides are leaves of one prediction is none."""
        if t.feature[i] < 0:
            return
        self._pruned(t, 2 * i)
        self._pruned(t, 2 * i + 1)
        kids = (2 * i, 2 * i + 1)
        said = [t.stats[k][1] / t.stats[k][0] if t.stats[k][0] else 0.0 for k in kids]
        if all(t.feature[k] < 0 for k in kids) and said[0] == said[1]:
            t.feature[i] = -1
            del t.gain[i]
            for k in kids:
                del t.stats[k], t.impurity[k]

    def _counted(self) -> np.ndarray:
        """(trees, heap) rows that every node was trained on: the bags are drawn once more."""
        trees, depth, rate, seed = [(t.feature, t.split) for t in self.trees], self.depth, self.rate, self.seed

        def count(b: Block) -> np.ndarray:
            out = np.zeros((len(trees), 2 << depth), dtype=np.int64)
            for k, (feature, split) in enumerate(trees):
                node = _walk(feature, split, b.bins, depth)
                out[k] = np.bincount(node if rate >= 1.0 else node[uniforms(seed + k + b.part + 1, len(node)) < rate], minlength=2 << depth)
            return out

        found = _summed(self.blocks.map(lambda b: (b.part, count(b))), self.parts)
        for i in range((1 << depth) - 1, 0, -1):
            found[:, i] += found[:, 2 * i] + found[:, 2 * i + 1]
        return found

    def _nodes(self, t: Tree, rows: np.ndarray | None = None) -> list[tuple]:
        """MLlib's rows of a tree, in pre-order; without ``rows`` by node, none are counted."""
        out: list = []

        def add(i: int) -> int:
            at, stats = len(out), t.stats[i]
            out.append(None)
            f = int(t.feature[i])
            kids = [add(2 * i), add(2 * i + 1)] if f >= 0 else [-1, -1]
            split = (f, [float(self.thresholds[f][t.split[i]])], -1) if f >= 0 else (-1, [], -1)
            out[at] = (at, float(t.value[i]), t.impurity[i], list(stats), int(rows[i]) if rows is not None else 0, t.gain.get(i, -1.0), *kids, split)
            return at

        add(1)
        return out

    def nodes(self) -> list[dict]:
        """The ensemble's node rows as ``model.tree_arrays`` reads them."""
        names = ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "featureIndex", "leftCategoriesOrThreshold")
        return [{"treeID": k, **dict(zip(names, (*row[:-1], *row[-1])))} for k, t in enumerate(self.trees) for row in self._nodes(t)]

    def weights(self) -> dict[int, float]:
        return {k: self.step if k else 1.0 for k in range(len(self.trees))}

    def model(self, est: GBTClassifier, path: str) -> GBTClassificationModel:
        """The ensemble as the model of ``est``, written to ``path`` and loaded.

        Its files are those of a model of one stump, with other nodes.
        """
        spark = self.spark
        ends = spark.createDataFrame([(Vectors.dense([x] * len(self.thresholds)), x, 1.0) for x in (0.0, 1.0)], ["features", "label", "weight"])
        stump = est.copy({est.maxIter: 1, est.cacheNodeIds: False}).fit(ends)
        stump.write().overwrite().save(f"{path}-stump")
        schema = spark.read.parquet(f"{path}-stump/data").schema
        counts = self._counted()
        nodes = [(k, row) for k, t in enumerate(self.trees) for row in self._nodes(t, counts[k])]
        spark.createDataFrame(nodes, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
        tree = spark.read.parquet(f"{path}-stump/treesMetadata").first()["_2"]
        spark.createDataFrame([(k, tree, w) for k, w in self.weights().items()], "_1 int, _2 string, _3 double") \
             .coalesce(1).write.mode("overwrite").parquet(f"{path}/treesMetadata")
        meta = spark.read.text(f"{path}-stump/metadata").first()["value"]
        meta = json.loads(meta) | {"numTrees": len(self.trees)}
        meta["paramMap"] |= {"maxIter": est.getMaxIter(), "cacheNodeIds": est.getCacheNodeIds()}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
        return GBTClassificationModel.load(path)


def _blocks(rows: DataFrame, thresholds: list[np.ndarray], xcols: list[str]) -> RDD:
    """A ``Block`` for every partition that has rows."""
    kind = np.uint8 if max(map(len, thresholds)) < 256 else np.uint16

    def pack(batches):
        bins, label, weight, part = [], [], [], 0
        for b in batches:
            if b.num_rows:
                part = b["part"][0].as_py()
                bins.append(np.stack([np.searchsorted(t, b[c].to_numpy(zero_copy_only=False)).astype(kind) for c, t in zip(xcols, thresholds)]))
                label.append(b["label"].to_numpy(zero_copy_only=False))
                weight.append(b["weight"].to_numpy(zero_copy_only=False))
        if bins:
            found = (np.concatenate(bins, axis=1), np.concatenate(label) * 2 - 1, np.concatenate(weight))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in found]],
                                             names=["part", "bins", "label", "weight"])

    packed = rows.select(F.spark_partition_id().alias("part"), "label", "weight", *xcols).mapInArrow(pack, "part int, bins binary, label binary, weight binary")

    def block(r) -> Block:
        label = np.frombuffer(bytes(r.label))
        return Block(r.part, np.frombuffer(bytes(r.bins), dtype=kind).reshape(len(thresholds), -1), label, np.frombuffer(bytes(r.weight)), np.zeros(len(label)))

    return packed.rdd.map(block)
