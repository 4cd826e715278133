"""Fitting fusion weights with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tetrarank.constants import DZ_COLUMNS, EXPERTS
from tetrarank.functions import distributions as dx
from tetrarank.functions import numeric as nx
from tetrarank.operators import evaluation, preferences
from tetrarank.operators.scale import checkpoint_dir, dropping_unused, stored

PARAMETER_BYTES = 64 << 20
#: Rows of a stored block of numbers, and of those that are in the processor's cache at once.
BLOCK_ROWS, AT_ONCE = 65_536, 8_192


def feature_matrix(df: DataFrame, numeric: list[str], levels: dict[str, list[str]], output: str = "features") -> DataFrame:
    """Differences, their derived signals, optional numeric columns (nulls as 0) and one-hot categories, assembled."""
    base = df.select("*", *preferences.derived_signals())
    names = [*DZ_COLUMNS, *[f"{p}_{c}" for c in DZ_COLUMNS for p in ("abs", "pos", "neg", "hit")]]
    for c in numeric:
        base = base.withColumn(f"__n_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        names.append(f"__n_{c}")
    for c, values in levels.items():
        for i, v in enumerate(values):
            base = base.withColumn(f"__c_{c}_{i}", (F.coalesce(F.col(c), F.lit("UNK")) == v).cast("double"))
            names.append(f"__c_{c}_{i}")
    assembled = VectorAssembler(inputCols=names, outputCol=output).transform(base)
    return assembled.select(*df.columns, output)


def fit_linear_ranker(pairs: DataFrame, features: list[str] | None = None, reg: float = 0.0, max_iter: int = 100) -> list[float]:
    """Weights of margin = w . dz under the pairwise logistic loss; no intercept. Returns raw weights."""
    features = features or DZ_COLUMNS
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(
        pairs.select(F.col("y").cast("double").alias("label"), *[F.col(f).cast("double") for f in features]))
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=reg, maxIter=max_iter, tol=1e-9).fit(rows)
    return [float(c) for c in model.coefficients]


def logistic_gradient(pairs: DataFrame, weights: list[float], features: list[str] | None = None) -> DataFrame:
    """feature, gradient of the mean pairwise logistic loss at the given weights: all zero at the optimum."""
    features = features or DZ_COLUMNS
    error = nx.sigmoid(linear_margin(weights, features)) - F.col("y")
    sums = pairs.agg(*[F.avg(error * F.col(f)).alias(f) for f in features])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("gradient")) for f in features])).alias("g")).select("g.*")


def l1_normalized(weights: list[float]) -> list[float]:
    total = sum(abs(w) for w in weights) + 1e-9
    return [w / total for w in weights]


def linear_margin(weights: list[float], features: list[str] | None = None):
    return reduce(lambda a, b: a + b, [F.col(f) * F.lit(float(w)) for f, w in zip(features or DZ_COLUMNS, weights)])


def fit_nonlinear_ranker(pairs: DataFrame, features: list[str] | None = None, hidden: int = 16, max_iter: int = 60, seed: int = 42):
    """A small sigmoid network on the differences: the nearest built-in to a hidden-layer ranker."""
    features = features or DZ_COLUMNS
    stages = [VectorAssembler(inputCols=features, outputCol="features"),
              MultilayerPerceptronClassifier(layers=[len(features), hidden, 2], maxIter=max_iter, seed=seed)]
    return Pipeline(stages=stages).fit(pairs.select(F.col("y").cast("double").alias("label"), *features))


def nonlinear_margin(model, pairs: DataFrame) -> DataFrame:
    """Margin = log-odds that the first item wins."""
    scored = model.transform(pairs)
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-9)), F.lit(1.0 - 1e-9))
    return scored.select(*pairs.columns, F.ln(p / (1.0 - p)).alias("margin"))


def _twin_terms(network: dict[str, np.ndarray], features: list[str]) -> list[tuple[Column, Column]]:
    """Per hidden unit its value on the differences and on their opposite."""
    out = []
    for row, shift in zip(network["w"], network["c"], strict=True):
        a = linear_margin(row.tolist(), features)
        out.append((F.tanh(a + float(shift)), F.tanh(-a + float(shift))))
    return out


def antisymmetric_margin(network: dict[str, np.ndarray], features: list[str] | None = None) -> Column:
    """g(dz) - g(-dz) of a hidden layer g: exchanging the two items turns the sign and nothing else."""
    terms = _twin_terms(network, features or DZ_COLUMNS)
    return reduce(lambda a, b: a + b, [float(v) * (here - there) for v, (here, there) in zip(network["v"], terms, strict=True)])


def antisymmetric_gradient(pairs: DataFrame, network: dict[str, np.ndarray], reg: float, features: list[str] | None = None) -> DataFrame:
    """parameter, gradient of the penalized mean loss at a network, in column expressions: all zero at an optimum."""
    features = features or DZ_COLUMNS
    error = nx.sigmoid(antisymmetric_margin(network, features)) - F.col("y")
    sums = {}
    for h, (here, there) in enumerate(_twin_terms(network, features)):
        v = float(network["v"][h])
        sums[f"v{h}"] = F.avg(error * (here - there)) + reg * v
        sums[f"c{h}"] = F.avg(error * v * (there * there - here * here)) + reg * float(network["c"][h])
        for i, f in enumerate(features):
            sums[f"w{h}_{f}"] = F.avg(error * v * (2.0 - here * here - there * there) * F.col(f)) + reg * float(network["w"][h, i])
    row = pairs.agg(*[c.alias(n) for n, c in sums.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("gradient")) for n in sums])).alias("g")).select("g.*")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of numbers to blocks of rows: one binary value each, column after column."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        data = np.concatenate([c.to_numpy().astype(np.float64, copy=False) for c in table.columns])
        return pa.RecordBatch.from_pydict({"block": pa.array([data.tobytes()], pa.binary())})

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= BLOCK_ROWS:
            yield block(held)
            held, count = [], 0
    if count:
        yield block(held)


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The batches of numbers that `_blocks` has stored, `width` columns each."""
    for batch in batches:
        for data in batch.column(0):
            columns = np.frombuffer(data.as_buffer(), np.float64).reshape(width, -1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[str(i) for i in range(width)])


def _loss_sums(hidden: int, width: int, theta: np.ndarray):
    """Arrow batches of (y, features...) to (position, value): rows, loss and gradient summed over the partition."""

    def run(batches):
        w, c, v = theta[:hidden * width].reshape(hidden, width), theta[hidden * width:hidden * (width + 1), None], theta[hidden * (width + 1):]
        shift = 2.0 * c
        total = np.zeros(2 + len(theta))
        for batch in batches:
            numbers = [c.to_numpy() for c in batch.columns]
            for at in range(0, batch.num_rows, AT_ONCE):
                y, x = numbers[0][at:at + AT_ONCE], np.stack([c[at:at + AT_ONCE] for c in numbers[1:width + 1]])
                a = 2.0 * (w @ x)
                with np.errstate(over="ignore"):  # tanh(c + a) and tanh(c - a), by exponentials, which are faster
                    here, there = 1.0 - 2.0 / (np.exp(shift + a) + 1.0), 1.0 - 2.0 / (np.exp(shift - a) + 1.0)
                twin = here - there
                margin = v @ twin
                small = np.exp(-np.abs(margin))
                error = np.where(margin >= 0, 1.0, small) / (1.0 + small) - y
                here *= here
                there *= there
                total[0] += len(y)
                total[1] += (np.log1p(small) + np.maximum(np.where(y > 0.5, -margin, margin), 0.0)).sum()
                total[2:] += np.concatenate([((((2.0 - here - there) * error) @ x.T) * v[:, None]).reshape(-1), ((there - here) @ error) * v, twin @ error])
        yield pa.RecordBatch.from_pydict({"position": pa.array(np.arange(len(total), dtype=np.int32)), "value": pa.array(total)})

    return run


def fit_antisymmetric_ranker(pairs: DataFrame, features: list[str] | None = None, hidden: int = 4, reg: float = 0.01, max_iter: int = 80,
                             tol: float = 1e-5, seed: int = 42) -> dict[str, np.ndarray]:
    """Weights (w, c, v) of a hidden-layer ranker under the pairwise logistic loss, by L-BFGS.

    The rows are stored once as blocks of numbers. Tasks sum loss and gradient over them; the sums are added in Spark, so a step brings one number per parameter to the driver.
    """
    features = features or DZ_COLUMNS
    rows = pairs.select(F.col("y").cast("double").alias("y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    rows = stored(rows.mapInArrow(_blocks, "block binary"), "blocks")
    width = len(features)

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        sums_of = _loss_sums(hidden, width, theta)
        sums = rows.mapInArrow(lambda batches: sums_of(_rows(batches, width + 1)), "position int, value double").groupBy("position").agg(F.sum("value")).collect()
        total = np.zeros(2 + len(theta))
        for position, value in sums:
            total[position] = value
        n = max(total[0], 1.0)
        return total[1] / n + 0.5 * reg * float(theta @ theta), total[2:] / n + reg * theta

    theta = minimize(evaluate, np.random.default_rng(seed).normal(scale=0.5, size=hidden * (width + 2)), max_iter, tol)
    return {"w": theta[:hidden * width].reshape(hidden, width), "c": theta[hidden * width:hidden * (width + 1)], "v": theta[hidden * (width + 1):]}


def minimize(evaluate, start: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking; `evaluate` returns (value, gradient)."""
    x = start
    value, gradient = evaluate(x)
    steps, turns = [], []
    for _ in range(max_iter):
        if np.abs(gradient).max() <= tol:
            break
        direction, weights = gradient.copy(), []
        for s, t in reversed(list(zip(steps, turns, strict=True))):
            a = (s @ direction) / (s @ t)
            weights.append(a)
            direction -= a * t
        if steps:
            direction *= (steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1])
        for (s, t), a in zip(zip(steps, turns, strict=True), reversed(weights), strict=True):
            direction += (a - (t @ direction) / (s @ t)) * s
        slope = -(gradient @ direction)
        if slope >= 0:
            direction, slope, steps, turns = gradient, -(gradient @ gradient), [], []
        size = 1.0
        while True:
            moved = x - size * direction
            new_value, new_gradient = evaluate(moved)
            if new_value <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size *= 0.5
        s, t = moved - x, new_gradient - gradient
        if s @ t > 1e-12:
            steps, turns = [*steps, s][-memory:], [*turns, t][-memory:]
        x, value, gradient = moved, new_value, new_gradient
    return x


def fit_weight_heads(design: DataFrame, features: list[str], targets: list[str], *, trees: int = 20, depth: int = 3,
                     rate: float = 0.2, seed: int = 42) -> dict[str, PipelineModel]:
    """One boosted regression per expert on the log of its target weight."""
    checkpoint_dir(design.sparkSession)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    data = assembler.transform(design.select(
        *features, *[F.ln(F.greatest(F.col(t), F.lit(1e-6))).alias(f"log_{t}") for t in targets])).checkpoint()
    heads = {}
    for expert, t in zip(EXPERTS, targets):
        booster = GBTRegressor(labelCol=f"log_{t}", featuresCol="features", predictionCol=f"head_{expert}", maxIter=trees,
                               maxDepth=depth, stepSize=rate, seed=seed)
        heads[expert] = PipelineModel(stages=[assembler, booster.fit(data)])
    return heads


def predict_weights(heads: dict[str, PipelineModel], design: DataFrame) -> DataFrame:
    """pred_*: softmax over the heads' outputs, a simplex per row."""
    out = design
    for head in heads.values():
        out = head.transform(out).drop("features")
    simplex = dx.softmax(F.array(*[F.col(f"head_{e}") for e in EXPERTS]), eps=1e-9)
    out = out.withColumn("__w", simplex)
    return out.select(*design.columns, *[F.col("__w")[i].alias(f"pred_{e}") for i, e in enumerate(EXPERTS)])


def save_heads(heads: dict[str, PipelineModel], folder: str) -> None:
    for expert, model in heads.items():
        model.write().overwrite().save(f"{folder}/{expert}")


def load_heads(folder: str) -> dict[str, PipelineModel]:
    return {e: PipelineModel.load(f"{folder}/{e}") for e in EXPERTS}


def cross_validate(design: DataFrame, pairs: DataFrame, features: list[str], targets: list[str], n_folds: int,
                   **settings) -> tuple[DataFrame, DataFrame]:
    """(fold metrics, out-of-fold predictions). `design` has a fold column; pairs are scored with the weights
    predicted for their prompt by the models that did not see it."""
    parts = []
    for fold in range(n_folds):
        train, test = design.where(F.col("fold") != fold), design.where(F.col("fold") == fold)
        heads = fit_weight_heads(train, features, targets, **settings)
        parts.append(predict_weights(heads, test))
    predictions = reduce(lambda a, b: a.unionByName(b), parts)
    weights = predictions.select("prompt_id", "fold", *[f"pred_{e}" for e in EXPERTS])
    margin = reduce(lambda a, b: a + b, [F.col(d) * F.col(f"pred_{e}") for d, e in zip(DZ_COLUMNS, EXPERTS)])
    scored = pairs.select("prompt_id", "y", *DZ_COLUMNS).join(weights, "prompt_id").withColumn("margin", margin)
    return evaluation.fused_pair_metrics(scored, by=["fold"]), predictions


def evaluate_heads(heads: dict[str, PipelineModel], design: DataFrame, pairs: DataFrame, targets: list[str],
                   slices: list[str]) -> tuple[DataFrame, DataFrame]:
    """(weight distances, pair metrics) of fitted heads, overall and per slice."""
    predicted = predict_weights(heads, design)
    distances = evaluation.weight_distances(predicted, targets, [f"pred_{e}" for e in EXPERTS], slices)
    margin = reduce(lambda a, b: a + b, [F.col(d) * F.col(f"pred_{e}") for d, e in zip(DZ_COLUMNS, EXPERTS)])
    scored = pairs.join(predicted.select("prompt_id", *[f"pred_{e}" for e in EXPERTS]), "prompt_id").withColumn("margin", margin)
    return distances, evaluation.ranker_report(scored)


def fit_factors(ratings: DataFrame, rank: int = 16, threshold: float = 4.0, max_iter: int = 8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(user vectors, item vectors) from implicit feedback on ratings at or above the threshold.

    A checkpoint after each step cuts its lineage, so shuffle files of earlier steps can be deleted while later ones run.
    """
    spark = ratings.sparkSession
    checkpoint_dir(spark)
    liked = ratings.where(F.col("rating") >= threshold).select(
        F.col("user_id").cast("int"), F.col("item_id").cast("int"), F.col("rating").cast("float"))
    als = ALS(rank=rank, maxIter=max_iter, userCol="user_id", itemCol="item_id", ratingCol="rating", implicitPrefs=True,
              seed=seed, coldStartStrategy="drop", checkpointInterval=1)
    with dropping_unused(spark):
        model = als.fit(liked)
    return (model.userFactors.select(F.col("id").cast("long").alias("user_id"), F.col("features").alias("vector")),
            model.itemFactors.select(F.col("id").cast("long").alias("item_id"), F.col("features").alias("vector")))


def gated_mixture(rows: DataFrame, features: str, parameters: dict[str, np.ndarray], *, hidden_scale: str = "relu") -> DataFrame:
    """Forward pass of a gated mixture with given weights, in Arrow batches: adds margin and w_*.

    logits = W2 act(W1 x + b1) + b2, divided by max(temp, 0.2), plus scale * log of the mixture;
    w = softmax(logits); margin = sum w * (a * dz + b) + bias . x + bias0 + mix weight . mix.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    shared = rows.sparkSession.sparkContext.broadcast(parameters)
    mixed = [f"mix_{e}" for e in EXPERTS]
    schema = T.StructType([*rows.schema.fields, T.StructField("margin", T.DoubleType()),
                           *[T.StructField(f"w_{e}", T.DoubleType()) for e in EXPERTS]])
    target = to_arrow_schema(schema)

    def forward(batches):
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(features))
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            hidden = x @ p["w1"].T + p["b1"]
            hidden = np.maximum(hidden, 0.0) if hidden_scale == "relu" else np.tanh(hidden)
            logits = (hidden @ p["w2"].T + p["b2"]) / max(float(p.get("temp", 1.0)), 0.2)
            margin = x @ p["bias"] + float(p.get("bias0", 0.0))
            if "mix_scale" in p:
                mix = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in mixed])
                logits = logits + np.clip(p["mix_scale"], 0.1, 5.0) * np.log(np.maximum(mix, 1e-6))
                margin = margin + mix @ p["mix_margin"]
            w = np.exp(logits - logits.max(axis=1, keepdims=True))
            w /= w.sum(axis=1, keepdims=True)
            dz = x[:, :len(EXPERTS)]
            margin = margin + (w * (p["a"] * dz + p["b"])).sum(axis=1)
            columns = [*batch.columns, pa.array(margin), *[pa.array(w[:, i]) for i in range(len(EXPERTS))]]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return rows.mapInArrow(forward, schema)
