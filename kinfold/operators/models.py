"""Tree ensembles in the LightGBM text format, and a trainer for surrogates.

A model is parsed on the driver, kept as numpy arrays and broadcast (its size
is that of the file, not of the data).  Prediction walks all rows of an Arrow
batch level by level.  Small models can be compiled to nested CASE expressions
instead and then stay in the JVM.  Relation heads are scored only on the rows
that need them, as an explicit filter: a UDF under CASE would run on every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the format: bits of decision_type, kinds of missing values, and what counts as zero.
CATEGORICAL, DEFAULT_LEFT = 1, 2
MISSING_NONE, MISSING_ZERO, MISSING_NAN = 0, 1, 2
ZERO = 1e-35


class UnsupportedModel(ValueError):
    """A model that would be evaluated wrongly."""


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    decision: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Leaf values of all rows; every step moves each row one level down."""
        if not len(self.feature):
            return np.full(len(x), self.leaf[0])
        node = np.zeros(len(x), np.int64)
        open_rows = np.arange(len(x))
        while len(open_rows):
            at = node[open_rows]
            kind = self.decision[at] >> 2 & 3
            v = x[open_rows, self.feature[at]]
            nan = np.isnan(v)
            v = np.where(nan & (kind != MISSING_NAN), 0.0, v)
            missing = ((kind == MISSING_ZERO) & (np.abs(v) <= ZERO)) | ((kind == MISSING_NAN) & nan)
            go_left = np.where(missing, (self.decision[at] & DEFAULT_LEFT) != 0, v <= self.threshold[at])
            node[open_rows] = np.where(go_left, self.left[at], self.right[at])
            open_rows = open_rows[node[open_rows] >= 0]
        return self.leaf[~node]

    def expression(self, columns: list[str], node: int = 0) -> Column:
        """The tree as nested CASE; null is the missing value."""
        if not len(self.feature) or node < 0:
            return F.lit(float(self.leaf[~node if len(self.feature) else 0]))
        c, kind = F.col(columns[self.feature[node]]).cast("double"), int(self.decision[node]) >> 2 & 3
        default = F.lit(bool(self.decision[node] & DEFAULT_LEFT))
        known = F.coalesce(c, F.lit(0.0)) if kind != MISSING_NAN else c
        left = known <= F.lit(float(self.threshold[node]))
        if kind == MISSING_ZERO:
            left = F.when(F.abs(known) <= ZERO, default).otherwise(left)
        if kind == MISSING_NAN:
            left = F.when(c.isNull(), default).otherwise(left)
        return F.when(left, self.expression(columns, int(self.left[node]))).otherwise(self.expression(columns, int(self.right[node])))


@dataclass
class Ensemble:
    features: list[str]
    classes: int  # outputs: 1 for a binary objective
    sigmoid: float | None
    trees: list[Tree]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))
        for i, t in enumerate(self.trees):
            out[:, i % self.classes] += t.predict(x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(np.asarray(x, float))
        if self.sigmoid is not None:
            return 1 / (1 + np.exp(-self.sigmoid * raw))
        e = np.exp(raw - raw.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def expressions(self) -> list[Column]:
        """Probabilities as JVM expressions, for models of few leaves."""
        raw = [sum((t.expression(self.features) for t in self.trees[k :: self.classes]), F.lit(0.0)) for k in range(self.classes)]
        if self.sigmoid is not None:
            return [1 / (1 + F.exp(-F.lit(self.sigmoid) * r)) for r in raw]
        top = F.greatest(*raw)
        total = sum((F.exp(r - top) for r in raw), F.lit(0.0))
        return [F.exp(r - top) / total for r in raw]


def _sections(text: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    head: dict[str, str] = {}
    trees: list[dict[str, str]] = []
    for line in text.splitlines():
        if line == "end of trees":
            break
        name, found, value = line.partition("=")
        if name == "Tree" and found:
            trees.append({})
        elif found:
            (trees[-1] if trees else head)[name] = value
    return head, trees


def _tree(number: int, block: dict[str, str], n_features: int) -> Tree:
    def numbers(name: str, kind: type) -> np.ndarray:
        if name not in block:
            raise UnsupportedModel(f"tree {number} has no {name}")
        return np.array(block[name].split(), kind)

    if block.get("num_cat", "").strip() != "0":
        raise UnsupportedModel(f"tree {number} splits by category")
    if block.get("is_linear", "0").strip() != "0":
        raise UnsupportedModel(f"tree {number} is linear")
    leaf = numbers("leaf_value", float)
    if numbers("num_leaves", int)[0] <= 1:
        none = np.zeros(0, int)
        return Tree(none, none.astype(float), none, none, none, leaf)
    tree = Tree(numbers("split_feature", int), numbers("threshold", float), numbers("decision_type", int), numbers("left_child", int), numbers("right_child", int), leaf)
    n = len(tree.feature)
    if any(len(a) != n for a in (tree.threshold, tree.decision, tree.left, tree.right)):
        raise UnsupportedModel(f"tree {number}: arrays of unlike length")
    if (tree.decision & CATEGORICAL).any():
        raise UnsupportedModel(f"tree {number} splits by category")
    if (tree.feature < 0).any() or (tree.feature >= n_features).any():
        raise UnsupportedModel(f"tree {number} splits on a feature that is not there")
    children = np.concatenate([tree.left, tree.right])
    if (children >= n).any() or (~children[children < 0] >= len(leaf)).any():
        raise UnsupportedModel(f"tree {number} has a child that is not there")
    return tree


def parse(text: str) -> Ensemble:
    """A model from its text; what cannot be evaluated exactly is refused."""
    head, blocks = _sections(text)
    for need in ("feature_names", "num_class", "objective"):
        if need not in head:
            raise UnsupportedModel(f"no {need}")
    if "average_output" in head or any(line == "average_output" for line in text.splitlines()):
        raise UnsupportedModel("averaged forests")
    objective, *options = head["objective"].split()
    if objective not in ("multiclass", "binary"):
        raise UnsupportedModel(f"objective {objective}")
    sigmoid = None
    if objective == "binary":
        sigmoid = next((float(o.removeprefix("sigmoid:")) for o in options if o.startswith("sigmoid:")), 1.0)
    features = head["feature_names"].split()
    classes = int(head["num_class"]) if sigmoid is None else 1
    trees = [_tree(i, b, len(features)) for i, b in enumerate(blocks)]
    if len(trees) % classes:
        raise UnsupportedModel(f"{len(trees)} trees for {classes} classes")
    return Ensemble(features, classes, sigmoid, trees)


def score(df: DataFrame, model: Ensemble, names: list[str]) -> DataFrame:
    """Adds one probability column for each output."""
    missing = [f for f in model.features if f not in df.columns]
    if missing:
        raise KeyError(f"features that the table lacks: {missing}")
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(list(shared.value.predict(x.to_numpy(float, na_value=np.nan))))

    inputs = F.struct(*[F.col(f).cast("double").alias(f) for f in model.features])
    scored = df.withColumn("_p", run(inputs))
    return scored.select(*df.columns, *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)])


def symmetric_structure(df: DataFrame, model: Ensemble, signed: list[str], name: str = "p_sibling_structure") -> DataFrame:
    """Mean P(sibling) of a pair and its mirror image; tracks only."""
    return _both_ways(df, model, signed, lambda p, q: (F.get(p, F.lit(2)) + F.get(q, F.lit(2))) / 2, name, F.col("type") == "track")


def antisymmetric_direction(df: DataFrame, model: Ensemble, signed: list[str], name: str = "p_a_derived") -> DataFrame:
    return _both_ways(df, model, signed, lambda p, q: (F.get(p, F.lit(0)) + 1 - F.get(q, F.lit(0))) / 2, name, F.lit(True))


def _both_ways(df: DataFrame, model: Ensemble, signed: list[str], combine, name: str, where: Column) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)
    mirror = np.array([-1.0 if f in signed else 1.0 for f in model.features])

    @F.pandas_udf("forward array<double>, mirrored array<double>")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            values = x.to_numpy(float, na_value=np.nan)
            yield pd.DataFrame({"forward": list(shared.value.predict(values)), "mirrored": list(shared.value.predict(values * mirror))})

    inputs = F.struct(*[F.col(f).cast("double").alias(f) for f in model.features])
    out = df.withColumn("_p", run(inputs))
    return out.withColumn(name, F.when(where, combine(F.col("_p.forward"), F.col("_p.mirrored")))).drop("_p")


def relation_stage(rows: DataFrame, score_relations, outputs: list[str]) -> DataFrame:
    """Scores the costly relation heads on RELATE rows alone; the others get nulls."""
    needed = rows.filter("verdict = 'RELATE'")
    rest = rows.filter("verdict is null or verdict <> 'RELATE'")
    return score_relations(needed).unionByName(rest.withColumns({o: F.lit(None).cast("double") for o in outputs}), allowMissingColumns=True)


def class_weights(df: DataFrame, keys: list[str], name: str = "weight") -> DataFrame:
    """1 / sqrt(rows of the class), at mean one; class counts are aggregated and joined, never windowed."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg((F.sum(F.sqrt("_n")) / F.sum("_n")).alias("_m"))  # sum of n / sqrt(n), over rows
    counts = counts.crossJoin(F.broadcast(total)).withColumn(name, 1 / F.sqrt("_n") / F.col("_m"))  # one row
    return df.join(counts.select(*keys, name), keys)


def train_surrogate(df: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 40, depth: int = 8, seed: int = 7):
    """A random forest in place of the boosted trees, which MLlib has not for several classes."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    filled = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(-1.0)) for f in features})
    stages = [
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=features, outputCol="_features"),
        RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, **({"weightCol": weight} if weight else {})),
    ]
    return Pipeline(stages=stages).fit(filled)


def importances(model, features: list[str], n: int = 25) -> list[tuple[str, float]]:
    """A surrogate's features by importance."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, values.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]
