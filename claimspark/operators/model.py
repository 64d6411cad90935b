"""Champion / challenger tree ensembles on Spark ML (ML-1..6, SNK-2, SNK-3, AGG-12).

Training runs on the executors through ``Pipeline.fit``. Missing feature
values become the sentinel -9999 (MLlib trees reject NaN), which gives them
their own bin at the low end of every feature.

Early stopping is on AUC, as in the source: every prefix of the ensemble is
scored on the evaluation rows in one pass, and the model is cut after the best
one, once ``patience`` further rounds bring nothing better (see ``early_stopped``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .. import constants as K
from . import boosting as BO
from . import metrics as ME
from .sampling import with_split

RUNS_SCHEMA = ("run_name string, model string, params map<string,string>, metrics map<string,double>, "
               "artifact string, created_at timestamp")


def model_input(df: DataFrame, label: str | None = "denial_label", carry: tuple[str, ...] = ()) -> DataFrame:
    """ARR-2: 36 features in contract order, null -> sentinel, as doubles.

    ``carry`` keeps extra input columns alongside (so later steps need no join).
    """
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(K.MISSING_SENTINEL)).alias(f"x_{c}") for c in K.FEATURE_COLS]
    keep = [c for c in ("claim_id", "bene_id", "split", "weight", *carry) if c in df.columns]
    if label and label in df.columns:
        keep.append(F.col(label).cast("double").alias("label"))
    return df.select(*keep, *cols)


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[f"x_{c}" for c in K.FEATURE_COLS], outputCol="features",
                           handleInvalid="error")


def training_frame(features: DataFrame) -> DataFrame:
    """The train / test split; the fit takes all training rows, and the test rows judge when to stop."""
    return with_split(features)


def champion(max_iter: int = K.GBT_PARAMS["maxIter"], **kw) -> GBTClassifier:
    """ML-1: boosted trees; positive rows weighted by neg/pos (class ratio)."""
    p = dict(maxDepth=K.GBT_PARAMS["maxDepth"], stepSize=K.GBT_PARAMS["stepSize"],
             subsamplingRate=K.GBT_PARAMS["subsamplingRate"], featureSubsetStrategy="0.8", seed=K.SPLIT_SEED,
             cacheNodeIds=True, checkpointInterval=10)
    p.update(kw)
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, **p)


def challenger(num_trees: int = K.RF_PARAMS["numTrees"], **kw) -> RandomForestClassifier:
    """ML-2: a different ensemble (random forest) with balanced class weights."""
    # no node ids kept: they are a number per row and tree, twice; a row finds its node by six comparisons
    p = dict(maxDepth=K.RF_PARAMS["maxDepth"], subsamplingRate=K.RF_PARAMS["subsamplingRate"],
             featureSubsetStrategy="0.8", seed=K.SPLIT_SEED, cacheNodeIds=False, checkpointInterval=10)
    p.update(kw)
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                                  numTrees=num_trees, **p)


@dataclass
class Trained:
    name: str
    model: PipelineModel
    params: dict
    best_iteration: int = 0
    history: tuple = ()  # AUC on the evaluation rows after each round


#: Rows of a training partition, about. The data decide the number, so that a model doesn't depend on the cluster.
PARTITION_ROWS = 100_000


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """Training makes many passes: spread rows evenly and keep them
    (memory, spilling to disk) for the duration of the fit."""
    n = max(1, -(-rows // PARTITION_ROWS))
    # bagging samples rows in partition order: fix the order so a rerun (or a
    # recomputed partition) trains the same model
    return (df.repartition(n, "claim_id").sortWithinPartitions("claim_id")
              .persist(StorageLevel.MEMORY_AND_DISK))


def _class_counts(train: DataFrame) -> tuple[int, int]:
    row = train.agg(F.sum((F.col("denial_label") == 1).cast("long")), F.count(F.lit(1))).first()
    return int(row[0] or 0), int(row[1] or 0)


#: Rounds of the first fit; each further fit doubles them, so all fits of a forest together cost at most twice the last one.
FIRST_ROUNDS = 40
#: Steps of a score in the evaluation histograms: an AUC is exact but for ties within a step.
SCORE_STEPS = 1 << 16


def prefix_auc(trees: TreeArrays, rows: DataFrame, start: int = 0) -> list[float]:
    """AUC of the first ``start`` + 1, ``start`` + 2, ... trees on labelled ``model_input`` rows.

    One pass: each task adds the trees' outputs up row by row and keeps, for
    every prefix, positives and negatives by score step; the histograms (at
    most trees x ``SCORE_STEPS`` rows, whatever the data) are summed and ranked
    by Spark.
    """
    xcols = [f"x_{c}" for c in K.FEATURE_COLS]
    n_trees = len(trees.roots)

    def tally(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            y = pdf["label"].to_numpy(dtype=float) > 0.5
            for k, p in enumerate(prefix_scores(trees, pdf[xcols].to_numpy(dtype=float)).T[start:], start):
                step = np.minimum((p * SCORE_STEPS).astype(np.int64), SCORE_STEPS - 1)
                keys, n = np.unique(step << 1 | y, return_counts=True)
                held[k] = np.concatenate([held.get(k, np.empty((0, 2), np.int64)), np.stack([keys, n], 1)])
                if len(held[k]) > 4 * SCORE_STEPS:
                    held[k] = _merged(held[k])
        for k, part in held.items():
            keys, n = _merged(part).T
            pos = keys & 1
            yield pd.DataFrame({"k": k, "step": keys >> 1, "pos": n * pos, "neg": n * (1 - pos)})

    steps = rows.select("label", *xcols).mapInPandas(tally, "k int, step long, pos long, neg long")
    steps = steps.groupBy("k", "step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    of = Window.partitionBy("k")  # SCORE_STEPS rows at most
    below = F.coalesce(F.sum("neg").over(of.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = steps.select("k", "pos", "neg", (F.col("pos") * (below + 0.5 * F.col("neg"))).alias("won"))
    auc = won.groupBy("k").agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))
    found = {r.k: r.auc for r in auc.collect()}  # a row per tree
    return [found.get(k) if found.get(k) is not None else 0.5 for k in range(start, n_trees)]


def _merged(part: np.ndarray) -> np.ndarray:
    keys, at = np.unique(part[:, 0], return_inverse=True)
    return np.stack([keys, np.bincount(at, weights=part[:, 1]).astype(np.int64)], 1)


def best_round(history: list[float], patience: int) -> tuple[int, bool]:
    """(the best round, from 0; whether ``patience`` rounds after it brought nothing better)."""
    best = 0
    for k, auc in enumerate(history):
        if auc > history[best]:
            best = k
        elif k - best >= patience:
            return best, True
    return best, False


def early_stopped(fit, rows: DataFrame, eval_rows: DataFrame, path: str, most: int, patience: int = K.EARLY_STOPPING_ROUNDS,
                  first: int = FIRST_ROUNDS) -> tuple[PipelineModel, int, list[float]]:
    """Model cut after its best round, that round (from 0), and the AUC after every round.

    ``fit(rounds)`` gives an estimator whose ensemble begins with the trees of
    the one for fewer rounds (equal seeds). Without improvement for
    ``patience`` rounds training ends; else the rounds are doubled, up to ``most``.
    Boosted trees grow on (``boosting``); a forest is fitted again.
    """
    spark, rounds, growth, history = rows.sparkSession, min(first, most), None, []
    try:
        while True:
            est = fit(rounds)
            if isinstance(est, GBTClassifier):  # grown on from the rounds before
                if not growth:
                    growth = BO.Growth(rows, est, [f"x_{c}" for c in K.FEATURE_COLS], assembler())
                    rows.unpersist()  # its blocks are written: memory is theirs
                growth.grow(rounds)
                trees = tree_table(growth.nodes(), growth.weights(), boosted=True)
                history = history + prefix_auc(trees, eval_rows, len(history))
            else:
                model = _saved(Pipeline(stages=[assembler(), est]).fit(rows), path)
                history = prefix_auc(tree_arrays(spark, path, model), eval_rows)
            best, done = best_round(history, patience)
            if done or rounds >= most or len(history) < rounds:
                if growth:
                    model = _saved(PipelineModel([assembler(), growth.model(est, f"{path}-grown")]), path)
                return (model if best + 1 == len(history) else cut(spark, path, model, best + 1)), best, history
            rounds = min(2 * rounds, most)
    finally:
        if growth:
            growth.close()


def _saved(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return model


def cut(spark: SparkSession, path: str, model: PipelineModel, n: int) -> PipelineModel:
    """The saved model with the first ``n`` trees of its ensemble, written beside it and loaded."""
    idx, last = len(model.stages) - 1, model.stages[-1]
    src, out = f"{path}/stages/{idx}_{last.uid}", f"{path}-first-{n}"
    nodes = spark.read.parquet(f"{src}/data").filter(F.col("treeID") < n)
    nodes.write.mode("overwrite").parquet(f"{out}/data")
    spark.read.parquet(f"{src}/treesMetadata").filter(F.col("_1") < n).coalesce(1).write.mode("overwrite").parquet(f"{out}/treesMetadata")
    meta = spark.read.text(f"{src}/metadata").select(F.regexp_replace("value", r'"numTrees":\d+', f'"numTrees":{n}').alias("value"))
    meta.coalesce(1).write.mode("overwrite").text(f"{out}/metadata")
    return PipelineModel([*model.stages[:-1], type(last).load(out)])


def _trained(name: str, fit, train: DataFrame, n: int, frame: DataFrame, path: str, most: int, params: dict) -> Trained:
    data = _spread(model_input(train), n)
    held_out = model_input(frame.filter(F.col("split") == "test"))
    model, best, history = early_stopped(fit, data, held_out, path, most)
    data.unpersist()
    est = fit(most)
    params |= {"maxDepth": str(est.getMaxDepth()), "subsamplingRate": str(est.getSubsamplingRate()), "n_rows": str(n),
               "n_trees": str(model.stages[-1].getNumTrees), "best_iteration": str(best), "rounds_trained": str(len(history))}
    return Trained(name, model, params, best, tuple(history))


def fit_champion(frame: DataFrame, path: str, max_iter: int = K.GBT_PARAMS["maxIter"]) -> Trained:
    """ML-1 on all training rows, stopped early on the test rows' AUC. ``path``: where the ensemble is saved."""
    train = frame.filter(F.col("split") == "train")
    n_pos, n = _class_counts(train)
    ratio = (n - n_pos) / max(n_pos, 1)  # AGG-12 scale_pos_weight
    weighted = train.withColumn("weight", F.when(F.col("denial_label") == 1, F.lit(ratio)).otherwise(F.lit(1.0)))
    params = {"model": "gbt", "maxIter": str(max_iter), "stepSize": str(K.GBT_PARAMS["stepSize"]), "scale_pos_weight": f"{ratio:.6f}"}
    return _trained("champion", lambda rounds: champion(max_iter=rounds), weighted, n, frame, path, max_iter, params)


def fit_challenger(frame: DataFrame, path: str, num_trees: int = K.RF_PARAMS["numTrees"]) -> Trained:
    """ML-2 on all training rows, grown until more trees don't raise the test rows' AUC."""
    train = frame.filter(F.col("split") == "train")
    _, n = _class_counts(train)
    params = {"model": "random_forest", "numTrees": str(num_trees), "class_weight": "balanced"}
    return _trained("challenger", lambda trees: challenger(num_trees=trees), ME.with_class_weight(train), n, frame, path, num_trees, params)


def score(model: PipelineModel, features: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """ML-6: probability of class 1, action and risk level per claim; ``carry`` keeps further input columns."""
    scored = model.transform(model_input(features, label=None, carry=carry))
    out = scored.select(*[c for c in ("claim_id", "bene_id", "split", *carry) if c in scored.columns],
                        vector_to_array("probability")[1].alias("prediction_prob"))
    return ME.decisions(out)


def evaluate(model: PipelineModel, labelled: DataFrame) -> DataFrame:
    """ML-3: metrics per split (train/test) for one model; the label is carried through the scoring."""
    scored = score(model, labelled, carry=("denial_label",)).withColumn("score", F.round("prediction_prob", 10))
    auc = ME.roc_auc_ap(scored)
    conf = ME.confusion(scored)
    return auc.join(conf, "split").join(ME.f1_precision_recall(conf), "split")


def importance(spark: SparkSession, trained: Trained, top_n: int = 20) -> DataFrame:
    """ML-5: split-gain importance, top N (36 values: a fixed-size vector)."""
    vec = trained.model.stages[-1].featureImportances.toArray()
    rows = [(trained.name, f, float(v)) for f, v in zip(K.FEATURE_COLS, vec)]
    rows.sort(key=lambda r: (-r[2], K.FEATURE_COLS.index(r[1])))
    rows = [(m, f, round(v, 6), i + 1) for i, (m, f, v) in enumerate(rows[:top_n])]
    return spark.createDataFrame(rows, "model string, feature string, importance double, rank int")


def save(trained: Trained, path: str) -> str:
    """SNK-2: Spark ML model + ordered feature list (written through Spark, so
    any shared file system the cluster names works)."""
    trained.model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(K.FEATURE_COLS),)], "feature_cols string") \
         .coalesce(1).write.mode("overwrite").json(path + "/feature_cols")
    return path


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    cols = json.loads(spark.read.json(path + "/feature_cols").first()["feature_cols"])
    return PipelineModel.load(path), cols


def run_record(spark: SparkSession, trained: Trained, metrics: DataFrame, artifact: str = "") -> DataFrame:
    """SNK-3: one `runs` row: params and scalar metrics (train_/test_ prefixed, and the best iteration)."""
    vals: dict[str, float] = {"best_iteration": float(trained.best_iteration)}
    for r in metrics.collect():  # one row per split: bounded (2 rows)
        for k, v in r.asDict().items():
            if k != "split" and v is not None:
                vals[f"{r['split']}_{k}"] = float(v)
    return spark.createDataFrame([(trained.name, trained.params.get("model", ""), trained.params, vals, artifact,
                                   None)], RUNS_SCHEMA).withColumn("created_at", F.current_timestamp())


def compare_runs(runs: DataFrame) -> DataFrame:
    """ML-4: champion vs challenger per metric (metric rows, model columns)."""
    long = runs.select("run_name", F.explode("metrics").alias("metric", "value"))
    wide = long.groupBy("metric").pivot("run_name", ["champion", "challenger"]).agg(F.first("value"))
    return wide.withColumn("delta", F.col("champion") - F.col("challenger"))


# --- tree structure for Tree SHAP and LIME ------------------------------------

@dataclass
class TreeArrays:
    """Flat node arrays of one ensemble; sizes bounded by trees x 2^(depth+1)."""
    feature: np.ndarray   # per node, -1 for leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray     # leaf prediction (tree output)
    cover: np.ndarray     # weighted training count reaching the node
    roots: np.ndarray     # root node index per tree
    weights: np.ndarray   # tree weight in the ensemble
    scale: float          # margin -> log-odds factor (2 for MLlib GBT; 0: a forest, whose outputs are averaged probabilities)


def tree_arrays(spark: SparkSession, model_path: str, model: PipelineModel | None = None) -> TreeArrays:
    """Read the saved ensemble's node table (bounded by the tree budget); ``model``: the pipeline that ``model_path`` holds.

    A forest's node value is its share of class 1.
    """
    model = model or PipelineModel.load(model_path)
    idx = len(model.stages) - 1
    base = f"{model_path}/stages/{idx}_{model.stages[-1].uid}"
    nodes = spark.read.parquet(f"{base}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold")
    # treesMetadata columns: _1 tree id, _2 tree params json, _3 tree weight
    meta = spark.read.parquet(f"{base}/treesMetadata").collect()
    return tree_table(nodes.collect(), {int(r["_1"]): float(r["_3"]) for r in meta}, isinstance(model.stages[-1], GBTClassificationModel))


def tree_table(nodes: list, tw: dict[int, float], boosted: bool) -> TreeArrays:
    """Flat arrays of an ensemble's node rows; ``tw``: weight by tree."""
    rows = sorted(nodes, key=lambda r: (r["treeID"], r["id"]))
    n = len(rows)
    feature = np.full(n, -1, dtype=np.int64)
    threshold = np.zeros(n)
    left = np.full(n, -1, dtype=np.int64)
    right = np.full(n, -1, dtype=np.int64)
    value = np.zeros(n)
    cover = np.zeros(n)
    offset: dict[int, int] = {}
    for i, r in enumerate(rows):
        offset.setdefault(r["treeID"], i)
    for i, r in enumerate(rows):
        off = offset[r["treeID"]]
        stats = r["impurityStats"]
        value[i] = r["prediction"] if boosted else stats[1] / max(sum(stats), 1e-300)
        cover[i] = stats[0] if boosted else sum(stats)
        if r["leftChild"] >= 0:
            feature[i] = r["featureIndex"]
            threshold[i] = r["leftCategoriesOrThreshold"][0]
            left[i] = off + r["leftChild"]
            right[i] = off + r["rightChild"]
    trees = sorted(offset)
    return TreeArrays(feature, threshold, left, right, value, cover,
                      np.array([offset[t] for t in trees]), np.array([tw[t] for t in trees]), 2.0 if boosted else 0.0)


def _flat(t: TreeArrays):
    """Leaves point to themselves with an infinite threshold, so every row can
    take exactly max-depth steps with no branch on 'is this a leaf'."""
    leaf = t.feature < 0
    feat = np.where(leaf, 0, t.feature).astype(np.int64)
    thr = np.where(leaf, np.inf, t.threshold)
    idx = np.arange(len(t.feature))
    child = np.stack([np.where(leaf, idx, t.left), np.where(leaf, idx, t.right)], axis=1).ravel()
    depth, frontier = 0, t.roots
    while len(frontier := frontier[~leaf[frontier]]):
        frontier, depth = np.concatenate([t.left[frontier], t.right[frontier]]), depth + 1
    return feat, thr, child, depth


#: Node indices that ``_leaf_values`` holds at a time (rows x trees): they stay in a core's cache.
WALK_CELLS = 1 << 17


def _leaf_values(t: TreeArrays, X: np.ndarray) -> np.ndarray:
    """(rows, trees) outputs of every tree: all trees advance one level per step, a slice of rows at a time."""
    feat, thr, child, depth = _flat(t)
    n, p = X.shape
    out = np.empty((n, len(t.roots)))
    rows = max(1, WALK_CELLS // max(1, len(t.roots)))
    for s in range(0, n, rows):
        part = np.ascontiguousarray(X[s:s + rows])
        Xf, base = part.ravel(), (np.arange(len(part)) * p)[:, None]
        node = np.broadcast_to(t.roots, (len(part), len(t.roots)))
        for _ in range(depth):
            go_right = Xf[base + feat[node]] > thr[node]
            node = child[2 * node + go_right]
        out[s:s + rows] = t.value[node]
    return out


def predict_margin(t: TreeArrays, X: np.ndarray) -> np.ndarray:
    """Ensemble margin for rows of X."""
    return _leaf_values(t, X) @ t.weights


def predict_proba(t: TreeArrays, X: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-t.scale * predict_margin(t, X)))


def prefix_scores(t: TreeArrays, X: np.ndarray) -> np.ndarray:
    """(rows, trees) probabilities of class 1 after the first 1, 2, ... trees."""
    total = np.cumsum(_leaf_values(t, X) * t.weights, axis=1)
    return 1.0 / (1.0 + np.exp(-t.scale * total)) if t.scale else total / np.cumsum(t.weights)
