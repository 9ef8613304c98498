"""SAMME boosting (discrete AdaBoost) of depth-limited Spark ML decision trees.

Each round fits a weighted ``DecisionTreeClassifier`` (distributed). The fitted
tree's leaves carry the weighted class totals of the rows that reached them, so
the weighted training error is read from the leaves on the driver (a tree of depth
3 has at most 8 leaves) instead of from another pass over the data. The stage
weight is ``alpha = lr * ln((1 - err) / err)``; misclassified rows get their weight
multiplied by ``exp(alpha)``, and the new total is known in closed form, so
normalising costs no pass either. The exponent of a row's weight is the sum of the alphas
of the stages that miss it. Every ``FOLD`` rounds it becomes a column of the cached rows, so the
expression of a round's weights holds no more than ``FOLD`` trees and round 100 costs what
round 10 does. A lost executor recomputes its rows from the stored copy through the
folds, one pass with each stage evaluated once; the copy is removed after the fit.

That copy is dealt out by a hash of the row's own values and sorted within each part
(and kept in executor storage while the fit runs), into a number of parts that doesn't
follow the cluster: rows read in any layout give the same parts, hence the same split candidates (Spark ML samples rows for them
above max(maxBins^2, 10,000) rows) and the same model for one seed.

Scoring is column arithmetic over the stage predictions, all in one projection:
d = (sum of alpha for UP votes - sum for DOWN votes) / sum(alpha) in [-1, 1],
class UP when d > 0. P(UP) = 1 / (1 + exp(-2 d)): in the public definition of SAMME a
stage votes +alpha for its class and -alpha / (K - 1) for the others, so for K = 2 the
symmetric decision is 2 d, and the class probabilities are the softmax of half of it.
"""

from __future__ import annotations

import json
import math
import os
import uuid

from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import ensure_checkpoint_dir, remove_folder, shared_folder

C = F.col
#: Rounds after which the exponents become a column.
FOLD = 8


def tree_spec(tree: DecisionTreeClassificationModel):
    """Nested tuples of a fitted tree: ``("split", feature_index, threshold, left, right)``
    or ``("leaf", prediction, weighted_class_totals)``; left means value <= threshold."""
    def walk(nd):
        if nd.getClass().getSimpleName() == "InternalNode":
            sp = nd.split()
            return ("split", int(sp.featureIndex()), float(sp.threshold()),
                    walk(nd.leftChild()), walk(nd.rightChild()))
        return ("leaf", float(nd.prediction()), [float(v) for v in nd.impurityStats().stats()])
    return walk(tree._java_obj.rootNode())


def tree_column(spec, features: list[str]) -> Column:
    """The tree's predicted class as a column (nested CASE WHEN). A null or NaN feature
    takes the right branch, as Spark ML does for NaN."""
    if spec[0] == "leaf":
        return F.lit(spec[1])
    _, fi, thr, left, right = spec
    return F.when(C(features[fi]) <= F.lit(thr), tree_column(left, features)) \
        .otherwise(tree_column(right, features))


def leaf_error(spec) -> tuple[float, float]:
    """(weighted misclassified, weighted total) of the training rows, from the leaves."""
    if spec[0] == "leaf":
        stats = spec[2]
        return sum(stats) - stats[int(spec[1])], sum(stats)
    a, b = leaf_error(spec[3]), leaf_error(spec[4])
    return a[0] + b[0], a[1] + b[1]


class SammeModel:
    """Stage weights, each stage's tree (``tree_spec`` form) and each tree's normalised
    feature importances. Everything is a few numbers per stage, held on the driver."""

    def __init__(self, features: list[str], alphas: list[float], specs: list,
                 importances: list[list[float]]):
        self.features = list(features)
        self.alphas = [float(a) for a in alphas]
        self.specs = list(specs)
        self.importances = [[float(v) for v in imp] for imp in importances]

    @staticmethod
    def from_trees(features: list[str], trees: list, alphas: list[float]) -> "SammeModel":
        return SammeModel(features, alphas, [tree_spec(t) for t in trees],
                          [t.featureImportances.toArray().tolist() for t in trees])

    @property
    def feature_importances(self) -> dict[str, float]:
        """Stage-weighted mean of the trees' (normalised) importances."""
        tot = sum(self.alphas)
        acc = [0.0] * len(self.features)
        for imp, a in zip(self.importances, self.alphas):
            for i, v in enumerate(imp):
                acc[i] += a * v
        return {f: (v / tot if tot > 0 else 0.0) for f, v in zip(self.features, acc)}

    def decision(self) -> Column:
        """Alpha-weighted vote in [-1, 1] over the feature columns (by name)."""
        vote = F.lit(0.0)
        for a, spec in zip(self.alphas, self.specs):
            vote = vote + F.lit(a) * (F.lit(2.0) * tree_column(spec, self.features) - F.lit(1.0))
        return vote / F.lit(sum(self.alphas) or 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``decision``, ``prediction`` (0/1), ``p_up``, ``confidence`` (percent),
        ``direction``. Feature columns are taken by name, in the model's order."""
        d = df.withColumn("decision", self.decision())
        p_up = F.lit(1.0) / (F.lit(1.0) + F.exp(C("decision") * -2.0))
        return d.withColumns({
            "prediction": (C("decision") > 0).cast("int"),
            "p_up": p_up,
        }).withColumns({
            "confidence": F.greatest(C("p_up"), F.lit(1.0) - C("p_up")) * 100,
            "direction": F.when(C("prediction") == 1, "UP").otherwise("DOWN"),
        })

    # ----------------------------------------------------------------- persistence
    def save(self, spark: SparkSession, path: str) -> None:
        """Two writes: ``stages`` (one row per stage: alpha, importances, the tree's nodes
        in pre-order) and ``config`` (features, overall importance)."""
        rows = [(i, a, imp, _flatten(spec))
                for i, (a, imp, spec) in enumerate(zip(self.alphas, self.importances, self.specs))]
        spark.createDataFrame(rows, STAGES_SCHEMA).write.mode("overwrite") \
            .parquet(os.path.join(path, "stages"))
        meta = {"features": self.features, "importance": self.feature_importances}
        spark.createDataFrame([(json.dumps(meta),)], "config string").coalesce(1) \
            .write.mode("overwrite").json(os.path.join(path, "config"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SammeModel":
        meta = json.loads(spark.read.json(os.path.join(path, "config")).first()["config"])
        # A model has one row per stage (at most the round count): bounded, driver-sized.
        st = sorted(spark.read.parquet(os.path.join(path, "stages")).collect(),
                    key=lambda r: r["stage"])
        return SammeModel(meta["features"], [r["alpha"] for r in st],
                          [_unflatten(r["nodes"]) for r in st],
                          [list(r["importances"]) for r in st])


STAGES_SCHEMA = ("stage int, alpha double, importances array<double>, "
                 "nodes array<struct<feature int, threshold double, left int, right int, "
                 "prediction double, stats array<double>>>")


def _flatten(spec) -> list[tuple]:
    """Pre-order node list; a split row has child indexes, a leaf row has left = -1."""
    out: list = []

    def add(nd) -> int:
        i = len(out)
        out.append(None)
        if nd[0] == "leaf":
            out[i] = (-1, None, -1, -1, nd[1], list(nd[2]))
        else:
            lft, rgt = add(nd[3]), add(nd[4])
            out[i] = (nd[1], nd[2], lft, rgt, None, None)
        return i
    add(spec)
    return out


def _unflatten(nodes) -> tuple:
    def build(i):
        n = nodes[i]
        if n["left"] < 0:
            return ("leaf", float(n["prediction"]), list(n["stats"]))
        return ("split", int(n["feature"]), float(n["threshold"]), build(n["left"]),
                build(n["right"]))
    return build(0)


def missed(spec, features: list[str]) -> Column:
    """Whether a stage misses the row: 1.0 or 0.0."""
    return (tree_column(spec, features) != C("__label")).cast("double")


def fit_samme(df: DataFrame, features: list[str], label: str = "target", rounds: int = 100,
              learning_rate: float = 0.1, max_depth: int = 3, max_bins: int = 256,
              seed: int = 42, parts: int = 16) -> SammeModel:
    """Fit on ``df`` (rows with non-null features and label). ``parts``: partitions of the stored
    copy; set it by the data (about 128 MB each), not by the cluster, to get the same model."""
    spark = df.sparkSession
    feats = list(features)
    folder = shared_folder(spark, "boost")
    df.select(*[C(f).cast("double").alias(f) for f in feats], C(label).cast("double").alias("__label")).write.parquet(folder)
    try:
        return _fit_stored(spark.read.parquet(folder), feats, rounds, learning_rate, max_depth, max_bins, seed, parts)
    finally:
        remove_folder(spark, folder)


def _fit_stored(stored: DataFrame, feats: list[str], rounds: int, learning_rate: float,
                max_depth: int, max_bins: int, seed: int, parts: int) -> SammeModel:
    # Nominal label metadata (2 classes) spares the fit a pass that finds the class count.
    meta = {"ml_attr": {"type": "nominal", "num_vals": 2, "name": "__label"}}
    dealt = stored.repartition(parts, F.xxhash64(*feats, "__label")).sortWithinPartitions(*feats, "__label")
    base = VectorAssembler(inputCols=feats, outputCol="__features").transform(
        dealt.withColumn("__label", C("__label").alias("__label", metadata=meta))).persist(StorageLevel.MEMORY_AND_DISK)
    n = base.count()
    if n == 0:
        raise ValueError("no training rows")
    d = base.withColumn("__w", F.lit(1.0 / n))
    exponent, scale, open_trees = F.lit(0.0), 1.0 / n, 0
    trees, alphas = [], []
    for m in range(rounds):
        dt = DecisionTreeClassifier(featuresCol="__features", labelCol="__label", weightCol="__w",
                                    maxDepth=max_depth, maxBins=max_bins, seed=seed + m,
                                    predictionCol="__pred", rawPredictionCol="__raw",
                                    probabilityCol="__prob")
        tree = dt.fit(d)
        spec = tree_spec(tree)
        miss_w, tot_w = leaf_error(spec)
        err = miss_w / tot_w if tot_w > 0 else 0.0
        if err <= 0.0:
            trees.append(tree)
            alphas.append(1.0)
            break
        if err >= 0.5:
            if not trees:
                raise ValueError("first stage no better than chance")
            break
        alpha = learning_rate * math.log((1.0 - err) / err)
        trees.append(tree)
        alphas.append(alpha)
        if m == rounds - 1:
            break
        scale /= (1.0 - err) + err * math.exp(alpha)
        exponent, open_trees = exponent + F.lit(alpha) * missed(spec, feats), open_trees + 1
        if open_trees == FOLD:
            folded = base.withColumn("__e", exponent).persist(StorageLevel.MEMORY_AND_DISK)
            folded.count()
            base.unpersist()
            base, exponent, open_trees = folded, C("__e"), 0
        d = base.withColumn("__w", F.exp(exponent) * F.lit(scale))
    base.unpersist()
    return SammeModel.from_trees(feats, trees, alphas)


def model_path(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder for a model under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "models", name or uuid.uuid4().hex)
