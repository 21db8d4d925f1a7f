"""Quality scores by histogram gradient-boosted trees over document statistics.

Spark fits the trees: its boosting bins every feature and sums gradients per bin across
executors. The fitted trees are flattened into arrays, and scoring walks all trees of a
batch at once with numpy, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from .common import cut, ship

ship(__name__)

#: Labelled documents that the trees are fitted on at most (those of least hash), then the usual settings.
MAX_TRAIN, TREES, DEPTH, BINS, STEP, SEED = 20_000, 20, 4, 64, 0.2, 11
THRESHOLD, FOLDS = 0.3, 5


def _per(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.lit(1), F.col(whole))


#: Statistics of a text, all computed from the ledger's measurements.
FEATURES = {
    "words": lambda: F.log1p("n_words"),
    "word_length": lambda: _per("word_chars", "n_words"),
    "symbols": lambda: _per("n_symbols", "n_words"),
    "duplicate_lines": lambda: _per("n_dup_lines", "n_lines"),
    "repeated_words": lambda: _per("n_repeat_words", "n_words"),
    "line_words": lambda: F.log1p(_per("n_words", "n_lines")),
    "uppers": lambda: _per("n_upper", "word_chars"),
    "exclamations": lambda: _per("n_exclamations", "n_words"),
}


@dataclass
class FlatTrees:
    """Trees as arrays of one row per tree; a leaf is its own child. value has the leaves' weighted predictions."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        tree = np.arange(len(self.feature))
        at = np.zeros((len(x), len(tree)), np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[tree, at]] <= self.threshold[tree, at]
            at = np.where(goes_left, self.left[tree, at], self.right[tree, at])
        return 1 / (1 + np.exp(-2 * self.value[tree, at].sum(axis=1)))


def flatten(model: GBTClassificationModel) -> FlatTrees:
    """The arrays of a fitted model."""
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights):
        nodes: list[tuple[int, float, int, int, float]] = []

        def visit(node: object, nodes: list = nodes, weight: float = weight) -> int:
            place = len(nodes)
            if node.subtreeDepth() == 0:
                nodes.append((0, 0.0, place, place, weight * node.prediction()))
                return place
            nodes.append(())
            split = node.split()
            left, right = visit(node.leftChild()), visit(node.rightChild())
            nodes[place] = (split.featureIndex(), split.threshold(), left, right, 0.0)
            return place

        visit(tree._java_obj.rootNode())
        trees.append(nodes)
    width = max(map(len, trees))
    padded = [t + [(0, 0.0, k, k, 0.0) for k in range(len(t), width)] for t in trees]
    columns = [np.array([[node[c] for node in t] for t in padded]) for c in range(5)]
    return FlatTrees(*columns, depth=max(tree.depth for tree in model.trees))


def fit(rows: DataFrame) -> FlatTrees | float:
    """Trees fitted on ``MAX_TRAIN`` rows (x: array<double>, label) at most; the only class, or 0.5 without rows, if there are not two."""
    order = F.xxhash64("x", "label")
    chosen = cut(
        rows.filter("label is not null").select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), order.alias("o"))
        .orderBy("o").limit(MAX_TRAIN)
    )
    classes = [r[0] for r in chosen.select("label").distinct().limit(3).collect()]
    if len(classes) < 2:
        return classes[0] if classes else 0.5
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=STEP, seed=SEED, minInstancesPerNode=5)
    return flatten(trees.fit(chosen.repartitionByRange(8, "o").sortWithinPartitions("o").drop("o")))


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == 0


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` (higher: label 1 likelier) and ``predicted``.

    labels: (doc_id, quality); rows with null in either teach nothing, and neither do
    labels of held-out documents. A null or empty text has statistics of zero and a score
    like any other; a null id counts as not held out. Repeated documents and repeated
    labels each count. Extra columns are not read.
    """
    stats = cut(quality_rules.measure(docs, id_col, text_col))
    table = stats.select(
        F.col(id_col).alias("_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
        F.array(*[f().cast("double") for f in FEATURES.values()]).alias("x"),
    )
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label")).filter("label is not null")
    trees = fit(table.filter("not held_out").join(known, "_id").select("x", "label"))
    if isinstance(trees, float):
        score = F.lit(trees)
    else:
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                yield pd.Series(trees.score(np.stack(x)) if len(x) else [], dtype="float64")

        score = F.pandas_udf(scored, "double")("x")
    out = table.select(F.col("_id").alias(id_col), "held_out", score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
