"""Supervised and anomaly models (M1-M9), SMOTE (D12), tree-path
contributions (X1) and the local surrogate (X2).

Features stay named DOUBLE columns; they are assembled into a vector only at
the Spark ML boundary. Custom models (isolation forest, contributions)
train per tree / score per batch with numpy inside Spark tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from .forest import Forest, Tree, fit_forest
from .lbfgs import lbfgs


def assemble(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


# -- M1 / M2 / M3 / M8 / M9 -------------------------------------------------
def _fit_materialised(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Iterative learners scan their input once per pass: persist it (memory,
    spilling to disk) so the upstream plan runs once, then release it."""
    data = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(data)
    finally:
        data.unpersist()


def fit_random_forest(train: DataFrame, features: Sequence[str], label: str = "label", num_trees: int = 100,
                      max_depth: int = 20, seed: int = 42) -> Forest:
    """M1: see :func:`tidewatch.operators.forest.fit_forest`."""
    return fit_forest(train, features, label, num_trees, max_depth, seed)


def score(model: PipelineModel | Forest, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Predictions hub rows: keep columns + y_score (class-1 probability) and
    y_pred (y_score > 0.5, M8)."""
    if isinstance(model, Forest):
        return model.score(df, keep).withColumn("y_pred", F.when(F.col("y_score") > 0.5, 1).otherwise(0))
    if isinstance(model.stages[-1], MultilayerPerceptronClassificationModel):
        return mlp_scores(model, df, keep).withColumn("y_pred", F.when(F.col("y_score") > 0.5, 1).otherwise(0))
    out = model.transform(df)
    if "probability" in out.columns:
        s = vector_to_array("probability")[1]
    else:
        s = F.col("prediction").cast("double")
    return out.select(*keep, s.alias("y_score"), F.when(s > 0.5, 1).otherwise(0).alias("y_pred"))


def partial_retrain(base: DataFrame, feedback: DataFrame, features: Sequence[str], label: str = "label",
                    mode: str = "append", current: Forest | None = None, **kw) -> Forest:
    """M2: ``new_only`` refits on the feedback rows alone (the reference's
    behaviour); ``append`` refits on base + feedback. Without feedback rows
    ``new_only`` has nothing to learn from and the ``current`` model stays."""
    if mode == "new_only" and current is not None and feedback.isEmpty():
        return current
    data = feedback if mode == "new_only" else base.select(*features, label).unionByName(
        feedback.select(*features, label))
    return fit_random_forest(data, features, label, **kw)


def fit_linear_svm(train: DataFrame, features: Sequence[str], label: str = "label", reg: float = 0.0,
                   max_iter: int = 100) -> PipelineModel:
    """M3: linear SVM on the full training data."""
    svc = LinearSVC(featuresCol="features", labelCol=label, regParam=reg, maxIter=max_iter)
    return _fit_materialised(Pipeline(stages=[assemble(features), svc]), train.select(*features, label))


def svm_scores(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    out = model.transform(df)
    margin = vector_to_array("rawPrediction")[1]
    return out.select(*keep, margin.alias("margin"), F.col("prediction").cast("int").alias("y_pred"))


#: sin(2 pi u) / u in powers of u * u, highest first: exact but for rounding up to a quarter turn.
_SINE = [(-1) ** k * (2 * math.pi) ** (2 * k + 1) / math.factorial(2 * k + 1) for k in range(10)][::-1]


def _fourier_map(features: Sequence[str], components: int, gamma: float | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random projections (features x components) and shifts, in full turns."""
    rng = np.random.default_rng(seed)
    g = 1.0 / len(features) if gamma is None else gamma
    w = rng.normal(0.0, math.sqrt(2 * g), (components, len(features)))
    shift = rng.uniform(0.0, 2 * math.pi, components)
    return np.ascontiguousarray(w.T) / (2 * math.pi), shift / (2 * math.pi)


def _cosines(x: np.ndarray, turns: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Fourier features of the rows ``x``. The cosines come from the sine's
    series in a few vector operations, several times faster than ``np.cos``."""
    t = x @ turns
    t += shift
    t -= np.rint(t)
    np.abs(t, out=t)
    np.subtract(0.25, t, out=t)
    square = t * t
    z = square * _SINE[0]
    z += _SINE[1]
    for c in _SINE[2:]:
        z *= square
        z += c
    z *= t
    z *= math.sqrt(2.0 / len(shift))
    return z


def _finite_rows(cols) -> np.ndarray:
    """Arrow columns as rows of numbers; a null or non-finite one counts as 0."""
    x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in cols])
    x[~np.isfinite(x)] = 0.0
    return x


def fourier_features(features: Sequence[str], components: int = 128, gamma: float | None = None, seed: int = 42):
    """An ARRAY<DOUBLE> column whose inner products approximate the kernel
    ``exp(-gamma * |x - y|^2)`` (Rahimi and Recht 2007): cosines of random
    projections, error about ``components ** -0.5``. ``gamma`` is 1 / number of
    features unless given, for features of unit variance. A null or non-finite
    feature counts as 0."""
    turns, shift = _fourier_map(features, components, gamma, seed)

    def cosines(*cols: pa.Array) -> pa.Array:
        z = _cosines(_finite_rows(cols), turns, shift)
        return pa.ListArray.from_arrays(np.arange(0, z.size + 1, components, dtype=np.int32), z.ravel())

    return F.arrow_udf(cosines, ArrayType(DoubleType()))(*[F.col(c).cast("double") for c in features])


def fit_platt(scored: DataFrame, margin: str = "margin", label: str = "label") -> LogisticRegressionModel:
    """Platt scaling: the logistic curve of the label on the margin. ``scored``
    must be rows that the margin's model hasn't learned from."""
    x = scored.select(array_to_vector(F.array(margin)).alias("m"), F.col(label).cast("double").alias("label"))
    return _fit_materialised(LogisticRegression(featuresCol="m", labelCol="label"), x)


def platt(scored: DataFrame, model: LogisticRegressionModel, margin: str = "margin", out: str = "probability") -> DataFrame:
    a, b = float(model.coefficients[0]), float(model.intercept)
    return scored.withColumn(out, 1 / (1 + F.exp(-(F.col(margin) * a + b))))


#: Rows of one packed row, and of one block whose Fourier features are held at once.
SVM_PACKED, SVM_BLOCK = 1 << 13, 256


class KernelSvm:
    """M3 with the radial kernel and probabilities: a linear SVM on random
    Fourier features, on all rows instead of a sample, calibrated by Platt
    scaling on the rows held back for it (``calibration`` of them, by a hash of
    the id). Predictions are by probability >= 0.5.

    The SVM is Spark ML's (its loss, penalty and optimizer), but Spark's learner
    keeps the mapped rows, a kilobyte each. Here only the features and the label
    are kept, packed, and each pass maps them again block by block."""

    def __init__(self, train: DataFrame, features: Sequence[str], id_col: str, label: str = "label", components: int = 128,
                 gamma: float | None = None, reg: float = 1e-4, max_iter: int = 50, calibration: float = 0.2, seed: int = 42):
        from .prep import hash_score
        self.features = list(features)
        self.turns, self.shift = _fourier_map(features, components, gamma, seed)
        held = F.coalesce(hash_score(id_col, seed) < calibration, F.lit(False))
        rows = train.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_label"), held.alias("_held"))
        rows = rows.where(F.col("_label").isNotNull())
        packed = self._pack(rows.where(~F.col("_held"))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.weights, self.intercept = self._fit(packed, reg, max_iter)
        finally:
            packed.unpersist()
        self.curve = fit_platt(rows.where("_held").select(F.col("_label").alias("label"), self._margin()))

    def _pack(self, rows: DataFrame) -> DataFrame:
        """A row for every ``SVM_PACKED`` rows of a partition."""
        names = self.features

        def run(batches):
            held = []

            def packed(n):
                x, y = (np.concatenate(c) for c in zip(*held))
                held[:] = [(x[n:], y[n:])]
                return pa.RecordBatch.from_pylist([{"x": x[:n].tobytes(), "y": y[:n].tobytes()}], pa.schema([("x", pa.binary()), ("y", pa.binary())]))

            for b in batches:
                y = b.column("_label").to_numpy(zero_copy_only=False)
                if not np.isin(y, (0.0, 1.0)).all():
                    raise ValueError("labels are 0 or 1")
                held.append((_finite_rows([b.column(c) for c in names]), y.astype(np.int8)))
                while sum(len(y) for _, y in held) >= SVM_PACKED:
                    yield packed(SVM_PACKED)
            if sum(len(y) for _, y in held):
                yield packed(SVM_PACKED)

        return rows.mapInArrow(run, "x binary, y binary")

    def _pass(self, packed: DataFrame, per_block, size: int, merge) -> np.ndarray:
        """``merge`` over the ``size`` numbers that ``per_block`` has for the
        Fourier features and signs (-1, 1) of a block: in each partition, then
        over one row of each."""
        turns, shift = self.turns, self.shift

        def run(batches):
            total = np.zeros(size)
            for b in batches:
                for x, y in zip(b.column("x"), b.column("y")):
                    x, y = np.frombuffer(x.as_buffer()).reshape(-1, len(turns)), np.frombuffer(y.as_buffer(), np.int8)
                    for i in range(0, len(y), SVM_BLOCK):
                        total = merge(total, per_block(_cosines(x[i:i + SVM_BLOCK], turns, shift), 2.0 * y[i:i + SVM_BLOCK] - 1.0))
            yield pa.RecordBatch.from_pylist([{"sums": total.tobytes()}], pa.schema([("sums", pa.binary())]))

        total = np.zeros(size)
        for r in packed.mapInArrow(run, "sums binary").collect():
            total = merge(total, np.frombuffer(r["sums"]))
        return total

    def _fit(self, packed: DataFrame, reg: float, max_iter: int) -> tuple[np.ndarray, float]:
        d = len(self.shift)

        def moments(z: np.ndarray, sign: np.ndarray) -> np.ndarray:
            off = z - z[0]                     # constant features have no variance at all
            s = off.sum(axis=0)
            return np.concatenate([[len(z), (sign > 0).sum()], z[0] + s / len(z), (off * off).sum(axis=0) - s * s / len(z)])

        def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            if not (a[0] and b[0]):
                return a if a[0] else b
            n, gap = a[0] + b[0], b[2:d + 2] - a[2:d + 2]
            return np.concatenate([a[:2] + b[:2], a[2:d + 2] + gap * (b[0] / n), a[d + 2:] + b[d + 2:] + gap * gap * (a[0] * b[0] / n)])

        stats = self._pass(packed, moments, 2 + 2 * d, merged)
        n, positive, mean = stats[0], stats[1], stats[2:d + 2]
        if not positive:
            raise ValueError("an SVM learns from rows of two classes")
        std = np.sqrt(np.maximum(stats[d + 2:], 0.0) / max(n - 1.0, 1.0))
        inverse = np.divide(1.0, std, out=np.zeros(d), where=std != 0)

        def value(at: np.ndarray) -> tuple[float, np.ndarray]:
            """Mean hinge loss and penalty of weights on centred features of unit variance."""
            w = at[:d] * inverse
            offset = at[d] - w @ mean

            def hinge(z: np.ndarray, sign: np.ndarray) -> np.ndarray:
                gap = 1.0 - sign * (z @ w + offset)
                up = np.where(gap > 0, -sign, 0.0)
                return np.concatenate([[np.maximum(gap, 0.0).sum(), up.sum()], up @ z])

            sums = self._pass(packed, hinge, 2 + d, np.add) / n
            grad = np.append((sums[2:] - sums[1] * mean) * inverse, sums[1])
            grad[:d] += reg * w * inverse      # the penalty is on the weights of the features as they are
            return sums[0] + 0.5 * reg * (w @ w), grad

        best = lbfgs(value, np.zeros(d + 1), max_iter, orthants=True)
        w = best[:d] * inverse
        return w, float(best[d] - w @ mean)

    def _margin(self):
        turns, shift, weights, intercept = self.turns, self.shift, self.weights, self.intercept

        def margins(*cols: pa.Array) -> pa.Array:
            x = _finite_rows(cols)
            return pa.array(np.concatenate([_cosines(x[i:i + SVM_BLOCK], turns, shift) @ weights for i in range(0, len(x), SVM_BLOCK)] or [np.zeros(0)]) + intercept)

        return F.arrow_udf(margins, DoubleType())(*[F.col(c).cast("double") for c in self.features]).alias("margin")

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        out = platt(df.select(*keep, self._margin()), self.curve)
        return out.withColumn("y_pred", F.when(F.col("probability") >= 0.5, 1).otherwise(0))


def feature_importances(model: Forest, features: Sequence[str]) -> DataFrame:
    """M9: (feature, importance): per tree the gains times the weight of the
    nodes that split on a feature, as shares; their mean over trees, as shares."""
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("name")) for i, f in enumerate(features)])).alias("x")
    n = model.nodes.where("left >= 0").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("cover")).alias("g"))
    share = F.col("g") / F.sum("g").over(Window.partitionBy("tree"))
    sums = n.withColumn("s", share).groupBy("feature").agg(F.sum("s").alias("s"))
    total = sums.agg(F.sum("s").alias("total"))
    x = sums.sparkSession.range(1).select(names).select("x.i", "x.name").join(sums, F.col("i") == F.col("feature"), "left").crossJoin(F.broadcast(total))
    return x.select(F.col("name").alias("feature"), F.coalesce(F.col("s") / F.col("total"), F.lit(0.0)).alias("importance"))


# -- M5 / A11 ---------------------------------------------------------------
def pca_reconstruction_error(df: DataFrame, features: Sequence[str], k: int, keep: Sequence[str]) -> DataFrame:
    """M5 re-aimed: the optimal linear autoencoder is PCA; error = mean squared
    difference between centred x and its rank-k reconstruction."""
    means = df.agg(*[F.avg(c).alias(c) for c in features])
    centred = df.crossJoin(F.broadcast(means.select(*[F.col(c).alias(f"_m_{c}") for c in features]))).select(
        *keep, *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in features])
    va = assemble(features, "x")
    x = va.transform(centred)
    model = PCA(k=min(k, len(features)), inputCol="x", outputCol="z").fit(x)
    # P has orthonormal columns and x is centred, so ||x - P P^T x||^2 =
    # ||x||^2 - ||z||^2 with z = P^T x: two array sums, no per-row matrix
    z = model.transform(x).select(*keep, vector_to_array("x").alias("x"), vector_to_array("z").alias("z"))
    sq = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    err = F.greatest(sq(F.col("x")) - sq(F.col("z")), F.lit(0.0)) / len(features)
    return z.select(*keep, err.alias("recon_error"))


# -- M4: isolation forest ---------------------------------------------------
def _c(n):
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + 0.5772156649015329) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def fit_isolation_forest(df: DataFrame, features: Sequence[str], id_col: str, n_trees: int = 100,
                         sample_size: int = 256, seed: int = 42) -> pd.DataFrame:
    """Each tree gets its own hash-chosen sample of ``sample_size`` rows
    (rows are assigned to trees by hash, then the smallest scores per tree
    kept by a bounded window); trees are grown in parallel with
    ``groupBy(tree).applyInPandas``. The forest is small (n_trees x 2*256
    nodes) and is returned to the driver to be broadcast for scoring."""
    n = df.count()
    p = min(1.0, 3.0 * sample_size / max(n, 1))          # per-tree inclusion
    q = min(1.0, n_trees * p)                            # any-tree pre-sample
    unit = lambda *parts: (F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << 53) - 1))
                           .cast("double") / float(1 << 53))
    pre = df.select(id_col, *features).filter(unit(F.lit("pre"), F.col(id_col)) < q)
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    x = pre.select("*", trees)
    x = x.withColumn("_u", unit(F.col("tree"), F.col(id_col))).filter(F.col("_u") < p / q)
    w = Window.partitionBy("tree").orderBy("_u")
    sample = x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample_size).drop("_u", "_r")
    depth_limit = int(np.ceil(np.log2(sample_size)))
    cols = list(features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100_003 + tree)
        X = pdf[cols].to_numpy(dtype=float)
        X = np.where(np.isnan(X), 0.0, X)
        nodes = []

        def build(idx, depth):
            nid = len(nodes)
            nodes.append([tree, nid, -1, 0.0, -1, -1, float(len(idx))])
            if depth >= depth_limit or len(idx) <= 1:
                return nid
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            ok = np.where(hi > lo)[0]
            if len(ok) == 0:
                return nid
            f = int(rng.choice(ok))
            t = float(rng.uniform(lo[f], hi[f]))
            left = idx[sub[:, f] < t]
            right = idx[sub[:, f] >= t]
            nodes[nid][2], nodes[nid][3] = f, t
            nodes[nid][4] = build(left, depth + 1)
            nodes[nid][5] = build(right, depth + 1)
            return nid
        build(np.arange(len(X)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    schema = "tree int, node int, feature int, threshold double, left int, right int, size double"
    forest = sample.groupBy("tree").applyInPandas(grow, schema).toPandas()
    forest.attrs["sample_size"] = sample_size
    return forest


def isolation_scores(df: DataFrame, forest: pd.DataFrame, features: Sequence[str], keep: Sequence[str],
                     sample_size: int = 256) -> DataFrame:
    """Anomaly score 2^(-E[h(x)]/c(psi)) per row, vectorised per Arrow batch."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(forest.to_dict("list"))
    cols = list(features)
    c_psi = float(_c(np.array([sample_size]))[0])

    def run(batches):
        fz = pd.DataFrame(bc.value)
        n_trees = int(fz["tree"].max()) + 1
        width = int(fz["node"].max()) + 1
        t, nd = fz["tree"].to_numpy(), fz["node"].to_numpy()
        at = t * width + nd
        # flat tables over (tree, node); a leaf leads to itself
        feat, thr = np.zeros(n_trees * width, dtype=np.int64), np.zeros(n_trees * width)
        child = np.repeat(np.arange(n_trees * width), 2)
        depth, ends = np.zeros(n_trees * width), np.zeros(n_trees * width)
        f, inner = fz["feature"].to_numpy(), fz["feature"].to_numpy() >= 0
        feat[at[inner]], thr[at[inner]] = f[inner], fz["threshold"].to_numpy()[inner]
        for side, c in enumerate(("left", "right")):
            child[2 * at[inner] + side] = (t * width + fz[c].to_numpy())[inner]
        level, parents, roots = 0, at[(nd == 0) & inner], np.arange(n_trees) * width
        is_inner = np.zeros(n_trees * width, dtype=bool)
        is_inner[at[inner]] = True
        while len(parents):
            level += 1
            below = np.concatenate([child[2 * parents], child[2 * parents + 1]])
            depth[below] = level
            parents = below[is_inner[below]]
        ends[at] = depth[at] + _c(fz["size"].to_numpy())
        for pdf in batches:
            X = np.nan_to_num(pdf[cols].to_numpy(dtype=float))
            means = np.zeros(len(X))
            for s in range(0, len(X), 1024):                       # all trees at once
                part = np.ascontiguousarray(X[s:s + 1024])
                row = np.arange(len(part))[:, None] * part.shape[1]
                node = np.broadcast_to(roots, (len(part), n_trees))
                for _ in range(level):
                    go_right = part.take(row + feat.take(node)) >= thr.take(node)
                    node = child.take(2 * node + go_right)
                means[s:s + 1024] = ends.take(node).mean(axis=1)
            out = pdf[list(keep)].copy()
            out["anomaly_score"] = np.power(2.0, -means / c_psi)
            yield out

    schema = df.select(*keep).schema.add("anomaly_score", DoubleType())
    return df.select(*keep, *cols).mapInPandas(run, schema)


# -- M7 ---------------------------------------------------------------------
#: Windows of one block of the perceptron's loss (the default of Spark ML), and blocks of one packed row.
MLP_BLOCK, PACKED_BLOCKS = 128, 64
PACKED = "steps binary, starts binary, labels binary"


def _packed(X: np.ndarray, labels: np.ndarray, width: int) -> dict[str, bytes]:
    """Windows (rows of ``X``) as one run of values and the place where each
    begins. A window that is the one before moved on by ``width`` values, as
    sliding windows are, adds ``width`` values only; any other adds all."""
    bits = X.view(np.int64)
    moved = np.zeros(len(X), bool)
    moved[1:] = (bits[1:, :-width] == bits[:-1, width:]).all(axis=1)
    own = np.repeat(~moved[:, None], X.shape[1], axis=1)
    own[:, -width:] = True
    starts = np.cumsum(np.where(moved, width, X.shape[1])) - X.shape[1]
    starts -= starts[0]
    return {"steps": X[own].tobytes(), "starts": starts.astype(np.int64).tobytes(), "labels": labels.astype(np.int8).tobytes()}


def pack_windows(windows: DataFrame, n_inputs: int) -> DataFrame:
    """Windows (``seq``, ``label``) for training passes: a row for every 8,192
    windows of a partition, where overlapping neighbours share their values."""
    flat = F.flatten("seq")
    x = windows.select(F.array(*[flat[i] for i in range(n_inputs)]).alias("flat"), F.col("label").cast("double").alias("label"),
                       F.size("seq").alias("length"))
    most = MLP_BLOCK * PACKED_BLOCKS

    def run(batches):
        held, width = [], n_inputs
        def packed(n):
            X, y = (np.concatenate(c) for c in zip(*held))
            held[:] = [(X[n:], y[n:])]
            return pa.RecordBatch.from_pylist([_packed(np.ascontiguousarray(X[:n]), y[:n], width)], pa.schema(
                [(c, pa.binary()) for c in ("steps", "starts", "labels")]))
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column("label").to_numpy(zero_copy_only=False)
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("labels are 0 or 1")
            length = b.column("length")[0].as_py() or 0
            width = n_inputs // length if length > 0 and n_inputs % length == 0 else n_inputs
            X = b.column("flat").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_inputs)
            if not np.isfinite(X).all():
                raise ValueError("window values must not be missing or infinite")
            held.append((X, y))
            while sum(len(y) for _, y in held) >= most:
                yield packed(most)
        if sum(len(y) for _, y in held):
            yield packed(most)

    return x.mapInArrow(run, PACKED)


def _layers(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spark ML's flat weights as (inputs x outputs, intercepts) of every layer."""
    out, at = [], 0
    for i, o in zip(layers, layers[1:]):
        out.append((weights[at:at + i * o].reshape(i, o), weights[at + i * o:at + i * o + o]))
        at += i * o + o
    return out


def _mlp_forward(net: list[tuple[np.ndarray, np.ndarray]], X: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Every layer's inputs, and the margin of class 1 before the softmax."""
    hidden = [X]
    for w, b in net[:-1]:
        z = hidden[-1] @ w
        z += b
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1.0
        hidden.append(np.divide(1.0, z, out=z))
    w, b = net[-1]
    return hidden, hidden[-1] @ (w[:, 1] - w[:, 0]) + (b[1] - b[0])


def mlp_gradient(weights: np.ndarray, layers: Sequence[int], X: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Cross entropy and its gradient of a perceptron with sigmoid layers and
    softmax of two classes on top, as sums over blocks of 128 rows of their
    means; blocks."""
    net, n = _layers(weights, layers), len(X)
    hidden, margin = _mlp_forward(net, X)
    share = np.full(n, 1.0 / MLP_BLOCK)
    if n % MLP_BLOCK:
        share[-(n % MLP_BLOCK):] = 1.0 / (n % MLP_BLOCK)
    y = labels.astype(float)
    loss = float(np.logaddexp(0.0, (1.0 - 2.0 * y) * margin) @ share)
    top = (1.0 / (1.0 + np.exp(-margin)) - y) * share
    last = hidden[-1].T @ top
    parts = [np.concatenate([np.column_stack([-last, last]).ravel(), [-top.sum(), top.sum()]])]
    delta = None
    for k in range(len(net) - 2, -1, -1):
        up = np.multiply.outer(top, net[-1][0][:, 1] - net[-1][0][:, 0]) if delta is None else delta @ net[k + 1][0].T
        up *= hidden[k + 1]
        np.subtract(1.0, hidden[k + 1], out=hidden[k + 1])
        up *= hidden[k + 1]
        delta = up
        parts.append(np.concatenate([(hidden[k].T @ delta).ravel(), delta.sum(axis=0)]))
    return loss, np.concatenate(parts[::-1]), -(-n // MLP_BLOCK)


def _mlp_pass(packed: DataFrame, layers: Sequence[int], rows: int = 1024):
    """The function weights -> (mean loss, gradient): a pass over the packed
    windows, each partition returning one row of sums (of the weights' size)."""
    n_in = layers[0]

    def value(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches):
            loss, blocks, grad = 0.0, 0, np.zeros(len(weights))
            with np.errstate(over="ignore", invalid="ignore"):
                for b in batches:
                    for steps, starts, labels in zip(*(b.column(c) for c in ("steps", "starts", "labels"))):
                        view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(steps.as_buffer()), n_in)
                        at, y = np.frombuffer(starts.as_buffer(), np.int64), np.frombuffer(labels.as_buffer(), np.int8)
                        for i in range(0, len(y), rows):
                            part = mlp_gradient(weights, layers, view[at[i:i + rows]], y[i:i + rows])
                            loss, grad, blocks = loss + part[0], grad + part[1], blocks + part[2]
            yield pa.RecordBatch.from_pylist([{"loss": loss, "blocks": blocks, "grad": grad.tobytes()}], pa.schema(
                [("loss", pa.float64()), ("blocks", pa.int64()), ("grad", pa.binary())]))
        sums = packed.mapInArrow(run, "loss double, blocks bigint, grad binary").collect()
        with np.errstate(invalid="ignore"):
            blocks = np.float64(sum(r["blocks"] for r in sums))
            return sum(r["loss"] for r in sums) / blocks, sum((np.frombuffer(r["grad"]) for r in sums), np.zeros(len(weights))) / blocks

    return value


def fit_sequence_mlp(windows: DataFrame, n_inputs: int, hidden: Sequence[int] = (32,), seed: int = 42,
                     max_iter: int = 50) -> PipelineModel:
    """M7 re-aimed: flattened 20-step windows -> multilayer perceptron. The
    windows are packed once and kept, so that a pass reads a window's last step
    instead of all its values; weights begin and end in Spark ML's classifier,
    whose optimizer, loss and blocks are kept."""
    layers = [n_inputs, *hidden, 2]
    some = windows.sparkSession.range(1, numPartitions=1).select(*[F.lit(0.0).alias(c) for c in ("label", *[f"f{i}" for i in range(n_inputs)])])

    def classifier(**start) -> PipelineModel:
        mlp = MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=0, **start)
        return Pipeline(stages=[assemble([f"f{i}" for i in range(n_inputs)]), mlp]).fit(some)

    first = classifier().stages[-1].weights.toArray()
    packed = pack_windows(windows, n_inputs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = lbfgs(_mlp_pass(packed, layers), first, max_iter)
    finally:
        packed.unpersist()
    return classifier(initialWeights=Vectors.dense(weights))


def mlp_scores(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Keep columns and ``y_score`` of a two-class perceptron, in batches."""
    first, mlp = model.stages[0], model.stages[-1]
    net = _layers(mlp.weights.toArray(), mlp.getLayers())
    schema = df.select(*keep).schema.add("y_score", DoubleType())
    kept = len(schema) - 1
    names = [f"_x{i}" for i in range(len(first.getInputCols()))]

    def run(batches):
        with np.errstate(over="ignore", invalid="ignore"):
            for b in batches:
                X = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
                score = 1.0 / (1.0 + np.exp(-_mlp_forward(net, X)[1]))
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(score)], names=schema.names)

    return df.select(*keep, *[F.col(c).cast("double").alias(n) for c, n in zip(first.getInputCols(), names)]).mapInArrow(
        run, schema)


def flatten_windows(windows: DataFrame, n_inputs: int, keep: Sequence[str]) -> DataFrame:
    flat = windows.withColumn("flat", F.flatten("seq"))
    return flat.select(*keep, F.col("label").cast("double").alias("label"),
                       *[F.col("flat")[i].alias(f"f{i}") for i in range(n_inputs)])


# -- D12: SMOTE -------------------------------------------------------------
def pivot_blocks(x: DataFrame, max_leaf: int, max_pivots: int, seed: int) -> DataFrame:
    """``x`` (a, c, v) with ``d`` (distances to the pivots of the row's class)
    and ``block``, of about ``max_leaf`` rows.

    A class has one pivot for ``max_leaf`` rows, at most ``max_pivots``: the row
    of smallest hash in each of as many hash buckets. A row belongs to the cell
    of its nearest pivot; a cell is cut into rings by the distance to that
    pivot, and a ring that equal distances leave too large is dealt by a hash."""
    h = F.xxhash64(F.lit(seed), "a")
    sizes = x.groupBy("c").agg(F.least(F.lit(max_pivots), F.ceil(F.count(F.lit(1)) / F.lit(float(max_leaf)))).alias("m"))
    pivots = (x.join(sizes, "c").groupBy("c", F.pmod(h, F.col("m")).alias("p")).agg(F.min_by("v", F.struct(h, "a")).alias("v"))
              .groupBy("c").agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("pivots")))
    far = "transform(pivots, p -> sqrt(aggregate(zip_with(v, p.v, (s, t) -> (s - t) * (s - t)), 0D, (s, t) -> s + t)))"
    x = x.join(pivots, "c").select("a", "c", "v", F.expr(far).alias("d"))
    x = x.withColumn("cell", F.array_position("d", F.array_min("d"))).withColumn("r", F.array_min("d")).checkpoint()
    rings = x.groupBy("c", "cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", [i / 256 for i in range(1, 256)], 10_000).alias("cuts"))
    # every (256 / rings)-th cut; rings of still larger cells are dealt by hash below
    every = "greatest(1, cast(floor(256 / ceil(n / {0:.1f}D)) as int))".format(max_leaf)
    rings = rings.select("c", "cell", F.expr(f"filter(cuts, (q, i) -> (i + 1) % {every} = 0 and 255 - i >= {every} / 2)").alias("cuts"))
    x = x.join(rings, ["c", "cell"]).withColumn("ring", F.size(F.filter("cuts", lambda q: q < F.col("r")))).drop("cuts", "r")
    parts = x.groupBy("c", "cell", "ring").agg(F.ceil(F.count(F.lit(1)) / F.lit(1.5 * max_leaf)).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "a"), F.col("parts"))
    return x.join(parts, ["c", "cell", "ring"]).select("a", "c", "v", "d", F.concat_ws("/", "cell", "ring", part).alias("block"))


def near_blocks(x: DataFrame, bounds: DataFrame, max_pivots: int) -> DataFrame:
    """``c, i, j, lo, hi`` of every pair of blocks of a class in which a row of
    ``i`` may have a neighbour in ``j``: by the triangle inequality two rows
    are at least as far apart as their distances to any pivot differ. ``bounds``
    (a, far) holds a distance that a row's neighbours don't exceed."""
    span = lambda f: F.filter(F.array(*[f(F.get("d", F.lit(i))) for i in range(max_pivots)]), lambda v: v.isNotNull())
    boxes = x.join(bounds, "a").groupBy("c", "block").agg(span(F.min).alias("lo"), span(F.max).alias("hi"), F.max("far").alias("far"))
    asks = boxes.select("c", F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), "far")
    gives = boxes.select("c", F.col("block").alias("j"), "lo", "hi")
    return asks.join(gives, "c").where("i != j").where(_gap("lo_i", "hi_i") + " <= far").select("c", "i", "j", "lo", "hi")


def _gap(lo: str, hi: str) -> str:
    """SQL for the least distance between rows whose distances to the pivots
    lie in [lo, hi] and those of a block, less the rounding error."""
    gaps = (f"transform(sequence(0, size(lo) - 1), n -> greatest(get({lo}, n) - get(hi, n) - 1e-9D * get({lo}, n), "
            f"get(lo, n) - get({hi}, n) - 1e-9D * get(lo, n)))")
    return f"array_max({gaps})"


def knn_within_class(df: DataFrame, id_col: str, vec: str, label: str, k: int = 5, leaf: int = 512,
                     max_leaf: int = 2048, seed: int = 42, max_pivots: int = 16) -> DataFrame:
    """(id, nn_rank, nn_id): nearest neighbours inside each class, by distance,
    then id.

    Exact for every size, by pivots: each block is first searched in itself,
    which bounds how far a row's neighbours can lie; a second pass looks only at
    pairs of blocks, and in them only at rows, that the triangle inequality
    doesn't rule out. Where it rules out none (vectors without clusters in many
    dimensions) comparisons grow with the square of a class. A tile compares
    ``leaf`` rows at a time by a matrix product and takes exact distances of
    those within its rounding error. No task holds more than two blocks.
    Ids are unique. Rows whose id, label or vector is NULL, or whose squared
    length isn't finite, take no part; a row is no neighbour of itself."""
    x = df.select(F.col(id_col).alias("a"), F.col(label).alias("c"), F.col(vec).cast("array<double>").alias("v")) \
          .filter(F.col("a").isNotNull() & F.col("c").isNotNull() & F.col("v").isNotNull()) \
          .filter(F.expr("abs(aggregate(v, 0D, (s, t) -> s + t * t)) < double('inf')"))
    x = pivot_blocks(x, max_leaf, max_pivots, seed).checkpoint()
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"a {id_type}, b {id_type}, d double"

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a", kind="stable")
        V, ids = np.stack(pdf["v"].to_numpy()), pdf["a"].to_numpy()
        return _nearest(V, ids, V, ids, np.full(len(ids), np.inf), k, leaf)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a", kind="stable")
        asks, ids, V = pdf["asks"].to_numpy(dtype=bool), pdf["a"].to_numpy(), np.stack(pdf["v"].to_numpy())
        return _nearest(V[asks], ids[asks], V[~asks], ids[~asks], pdf["far"].to_numpy()[asks], k, leaf)

    own = x.select("a", "c", "v", "block").groupBy("c", "block").applyInPandas(within, schema).checkpoint()
    found = own.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("d")) * (1 + 1e-9)).alias("found"))
    bounds = x.select("a").join(found, "a", "left").select("a", F.coalesce("found", F.lit(float("inf"))).alias("far")).checkpoint()
    near = near_blocks(x, bounds, max_pivots).checkpoint()
    asks = x.withColumnRenamed("block", "i").join(bounds, "a").join(near, ["c", "i"]).where(_gap("d", "d") + " <= far") \
            .select("a", "c", "v", "i", "j", "far", F.lit(True).alias("asks"))
    gives = x.withColumnRenamed("block", "j").join(near.select("c", "i", "j"), ["c", "j"]) \
             .select("a", "c", "v", "i", "j", F.lit(0.0).alias("far"), F.lit(False).alias("asks"))
    pairs = own.unionAll(asks.unionAll(gives).groupBy("c", "i", "j").applyInPandas(across, schema))
    w = Window.partitionBy("a").orderBy("d", "b")
    return (pairs.withColumn("nn_rank", F.row_number().over(w)).filter(F.col("nn_rank") <= k)
            .select(F.col("a").alias(id_col), "nn_rank", F.col("b").alias("nn_id")))


def _nearest(Q: np.ndarray, own: np.ndarray, V: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int, leaf: int) -> pd.DataFrame:
    """(a, b, d): up to ``k`` of ``V`` (rows by id) for each of ``Q``, none
    beyond ``far``; ``d`` is the squared distance, summed dimension by
    dimension, so that a pair's is the same in any tile."""
    out = [pd.DataFrame({"a": own[:0], "b": ids[:0], "d": np.zeros(0)})]
    if len(ids) and len(own):
        square, G = (V * V).sum(axis=1), np.ascontiguousarray(V.T)
        unit = 8 * (V.shape[1] + 8) * np.finfo(float).eps
        for s in range(0, len(Q), leaf):
            q = Q[s:s + leaf]
            length = (q * q).sum(axis=1)
            error = (unit * (length + square.max()))[:, None]
            d = length[:, None] + square - 2 * (q @ G)
            d[own[s:s + leaf, None] == ids[None, :]] = np.inf
            at = min(k, len(ids)) - 1
            last = np.minimum(np.partition(d, at, axis=1)[:, at], far[s:s + leaf] ** 2)[:, None]
            row, at = np.nonzero((d <= last + 2 * error) & np.isfinite(d))
            exact = np.zeros(len(row))
            for n in range(len(G)):
                t = q[row, n] - G[n, at]
                exact += t * t
            order = np.lexsort((at, exact, row))
            row, at, exact = row[order], at[order], exact[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pd.DataFrame({"a": own[s + row[best]], "b": ids[at[best]], "d": exact[best]}))
    return pd.concat(out)


def smote(df: DataFrame, id_col: str, vec: str, label: str, k: int = 5, seed: int = 42, trace: bool = False) -> DataFrame:
    """Every class is topped up to the majority count with synthetic rows
    x + u * (nn - x). Each row of a class is a donor ``need // n`` times, the
    first ``need % n`` in hash order once more; neighbour and u come from
    hashes of (seed, class, donor, number), so runs repeat. Rows are counted
    per hash bucket, so a class is never ranked in one task. Output: original
    rows (synthetic=false) plus synthetic rows (id NULL); ``trace`` adds the
    donor, the neighbour and u. Rows without a label or vector stay as they are
    and have no synthetic ones."""
    usable = df.filter(F.col(label).isNotNull() & F.col(vec).isNotNull() & F.col(id_col).isNotNull())
    x = usable.select(F.col(id_col).alias("a"), F.col(label).alias("c"), F.col(vec).alias("v")) \
              .withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "a"), F.lit(1024)))
    sizes = x.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    target = sizes.agg(F.max("n").alias("target"))
    need = sizes.crossJoin(F.broadcast(target)).withColumn("need", F.col("target") - F.col("n")).filter("need > 0") \
                .select("c", F.expr("need div n").alias("each"), (F.col("need") % F.col("n")).alias("more"))
    w = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (x.groupBy("c", "b").agg(F.count(F.lit(1)).alias("m"))
               .withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0))).drop("m"))
    minority = x.join(need, "c")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("c", "b").orderBy("a"))
    donors = minority.join(buckets, ["c", "b"]).withColumn("times", F.col("each") + F.when(rank <= F.col("more"), 1).otherwise(0))
    # in blocks, so that one row never holds an array of all its copies
    block = 1000
    gen = (donors.filter("times > 0").select("a", "c", "v", "times", F.explode(F.expr(f"sequence(0L, (times - 1) div {block})")).alias("blk"))
           .select("a", "c", "v", F.explode(F.expr(f"sequence(blk * {block}, least(times, (blk + 1) * {block}) - 1)")).alias("i")))
    h = lambda tag: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(tag), F.col("c").cast("string"),
                                                           F.col("a").cast("string"), F.col("i").cast("string"))), 1, 13), 16, 10)
                     .cast("double") / float(16 ** 13))
    gen = gen.withColumn("nn_rank", (F.floor(h("nn") * k) + 1).cast("int")).withColumn("u", h("gap"))
    nn = knn_within_class(minority.select(F.col("a").alias("a"), "c", "v"), "a", "v", "c", k, seed=seed).withColumnRenamed("a", "donor")
    found = gen.join(nn, (F.col("a") == F.col("donor")) & (gen["nn_rank"] == nn["nn_rank"]), "left") \
               .select("a", "c", "v", "u", "nn_id")
    other = x.select(F.col("a").alias("nn_key"), F.col("v").alias("nv"))
    with_vec = found.join(other, F.col("nn_id") == F.col("nn_key"), "left")
    point = F.when(F.col("nv").isNull(), F.col("v")).otherwise(F.zip_with("v", "nv", lambda p, q: p + F.col("u") * (q - p)))
    extra = [F.col("a").alias("donor_id"), "nn_id", "u"] if trace else []
    synth = with_vec.select(F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), point.alias(vec),
                            F.col("c").alias(label), F.lit(True).alias("synthetic"), *extra)
    return df.select(id_col, vec, label, F.lit(False).alias("synthetic")).unionByName(synth, allowMissingColumns=True)


# -- X1: tree-path contributions --------------------------------------------
def forest_nodes(model: Forest) -> DataFrame:
    """Node table of the forest (tree, id, class-1 value, cover, feature,
    threshold, left, right); leaves have feature and children -1."""
    return model.nodes.select("tree", "id", "value", "cover", "feature", "threshold", "left", "right")


def tree_contributions(model: Forest, df: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    """Per row and feature, the change in class-1 probability along each
    tree's decision path, averaged over trees (path attribution). Base value
    + sum of contributions = predicted probability. Long-form output
    (id, feature, contribution) plus one ``__base__`` row per id.

    Rows between the same thresholds take the same paths, so paths are
    followed once for each such cell and tree."""
    n = len(features)

    def follow(x: np.ndarray, tree: Tree) -> np.ndarray:
        steps = np.zeros((len(tree.value), n + 1))
        steps[0, n] = tree.value[0]
        for node in tree.levels():
            for child in (tree.left[node], tree.right[node]):
                steps[child] = steps[node]
                steps[child, tree.feature[node]] += tree.value[child] - tree.value[node]
        return steps[tree.leaf(x)]

    means = model.mean_over_trees(df, follow, n + 1)
    x = means.select(id_col, *[F.col("_mean")[i].alias(f) for i, f in enumerate([*features, "__base__"])])
    return x.unpivot([id_col], [*features, "__base__"], "feature", "contribution")


# -- X1: Shapley values -----------------------------------------------------
def leaf_boxes(tree: pd.DataFrame, n_features: int) -> tuple[np.ndarray, ...]:
    """Per leaf of one tree: its class-1 value, the box ``(lo, hi]`` of the
    rows that reach it, and per feature the share of training rows that its
    splits on that feature let through."""
    t = Tree(tree)
    size = (len(t.value), n_features)
    lo, hi, share = np.full(size, -np.inf), np.full(size, np.inf), np.ones(size)
    for node in t.levels():
        f, at = t.feature[node], t.threshold[node]
        for child in (t.left[node], t.right[node]):
            lo[child], hi[child], share[child] = lo[node], hi[node], share[node]
            share[child, f] *= t.cover[child] / t.cover[node]
        hi[t.left[node], f] = np.minimum(hi[node, f], at)
        lo[t.right[node], f] = np.maximum(lo[node, f], at)
    ends = t.left < 0
    return t.value[ends], lo[ends], hi[ends], share[ends]


def leaf_shapley(x: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, share: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """Shapley values of one tree for the rows of ``x``: what a leaf adds when
    the features of a set are known is its value times, per feature, whether
    the row is inside its box (known) or the share (unknown). Sets of equal
    size weigh the same, so the sum over all sets of the other features is a
    polynomial with a factor (share + inside * y) for each, its coefficients
    weighted by size."""
    n = x.shape[1]
    weight = [math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) for k in range(n)]
    out, step = np.zeros(x.shape), max(1, cells // max(1, len(x)))
    for at in range(0, len(value), step):
        part = slice(at, at + step)
        inside = [((x[:, j:j + 1] > lo[part, j]) & (x[:, j:j + 1] <= hi[part, j])).astype(float) for j in range(n)]
        for i in range(n):
            poly = [np.ones((len(x), len(value[part])))]
            for j in range(n):
                if j != i:
                    z, o = share[part, j], inside[j]
                    poly = [(poly[k] * z if k < len(poly) else 0) + (poly[k - 1] * o if k else 0) for k in range(len(poly) + 1)]
            sets = sum(c * w for c, w in zip(poly, weight, strict=True))
            out[:, i] += ((inside[i] - share[part, i]) * sets * value[part]).sum(axis=1)
    return out


def shapley_contributions(model: Forest, df: DataFrame, features: Sequence[str], id_col: str, block_rows: int = 256) -> DataFrame:
    """Exact Shapley values of the forest's class-1 probability per row
    and feature, unknown features being taken by the training rows' shares at
    each split. Long form ``(id, feature, contribution)`` with a ``__base__``
    row per id; they sum to the row's probability.

    Work is rows x leaves: one group holds one tree and a block of rows, so
    trees and blocks run in parallel; it is meant for the rows to explain."""
    trees = model.num_trees
    n, id_type = len(features), df.schema[id_col].dataType
    x = df.select(F.col(id_col).alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")).checkpoint()
    blocks = max(1, -(-x.count() // block_rows))
    rows = x.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    nodes = forest_nodes(model).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def explain(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"id": rows["id"], "phi": [], "base": []})
        value, lo, hi, share = leaf_boxes(tree, n)
        phi = leaf_shapley(np.stack(rows["x"].to_list()), value, lo, hi, share)
        return pd.DataFrame({"id": rows["id"], "phi": phi.tolist(), "base": float((value * share.prod(axis=1)).sum())})

    schema = StructType().add("id", id_type).add("phi", ArrayType(DoubleType())).add("base", DoubleType())
    got = rows.groupBy("tree", "block").cogroup(nodes.groupBy("tree", "block")).applyInPandas(explain, schema)
    sums = got.groupBy("id").agg(*[(F.sum(F.col("phi")[i]) / trees).alias(f) for i, f in enumerate(features)], (F.sum("base") / trees).alias("__base__"))
    return sums.withColumnRenamed("id", id_col).unpivot([id_col], [*features, "__base__"], "feature", "contribution")


# -- X2: local surrogate ----------------------------------------------------
def local_surrogate(model: Forest, instances: DataFrame, features: Sequence[str], id_col: str,
                    scale: DataFrame, n_samples: int = 1000, kernel_width: float | None = None,
                    top: int = 5, seed: int = 42) -> DataFrame:
    """Perturb each instance ``n_samples`` times with Gaussian noise of each
    feature's std (``scale``: one row of ``{f}__sd``), score the perturbations
    with the model in Spark, weight by an exponential kernel of the scaled
    distance, and fit a weighted linear surrogate per instance from grouped
    normal-equation sums (a (d+1)^2 solve per instance). Returns the ``top``
    features by |coefficient| per instance."""
    d = len(features)
    width = kernel_width or 0.75 * np.sqrt(d)
    cols = list(features)
    x = instances.select(id_col, *cols).crossJoin(F.broadcast(scale)).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("s"))

    def unif(c, tag):
        return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(tag), F.col(id_col).cast("string"),
                                                      F.col("s").cast("string"))), 1, 12), 16, 10)
                .cast("double") + 0.5) / float(16 ** 12)
    z = {c: F.sqrt(-2.0 * F.log(unif(c, f"{c}a"))) * F.cos(2 * np.pi * unif(c, f"{c}b")) for c in cols}
    pert = x.select(id_col, "s", *[(F.col(c) + z[c] * F.col(f"{c}__sd")).alias(c) for c in cols],
                    *[z[c].alias(f"z_{c}") for c in cols])
    scored = score(model, pert, [id_col, "s", *[f"z_{c}" for c in cols]]).withColumnRenamed("y_score", "y")
    dist2 = sum((F.col(f"z_{c}") ** 2 for c in cols[1:]), F.col(f"z_{cols[0]}") ** 2)
    wcol = F.exp(-dist2 / (width ** 2))
    terms = [F.lit(1.0)] + [F.col(f"z_{c}") for c in cols]
    aggs = []
    for i in range(d + 1):
        aggs.append(F.sum(wcol * terms[i] * F.col("y")).alias(f"b{i}"))
        for j in range(i, d + 1):
            aggs.append(F.sum(wcol * terms[i] * terms[j]).alias(f"a{i}_{j}"))
    sums = scored.groupBy(id_col).agg(*aggs)

    def solve(batches):
        for pdf in batches:
            n = len(pdf)
            A, b = np.zeros((n, d + 1, d + 1)), np.zeros((n, d + 1, 1))
            for i in range(d + 1):
                b[:, i, 0] = pdf[f"b{i}"]
                for j in range(i, d + 1):
                    A[:, i, j] = A[:, j, i] = pdf[f"a{i}_{j}"]
            coef = np.linalg.solve(A + 1e-9 * np.eye(d + 1), b)[:, 1:, 0]
            yield pd.DataFrame({id_col: np.repeat(pdf[id_col].to_numpy(), d), "feature": np.tile(np.array(cols, object), n),
                                "weight": coef.ravel()})

    schema = instances.select(id_col).schema.add("feature", StringType()).add("weight", DoubleType())
    coefs = sums.mapInPandas(solve, schema)   # one row of sums per instance
    w = Window.partitionBy(id_col).orderBy(F.desc(F.abs("weight")), "feature")
    return coefs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
