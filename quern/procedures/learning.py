"""Learning procedures on Spark ML, nearest neighbours, and metrics as DataFrames."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dialect.lexer import QueryError
from ..engine import Function
from ..functions.arithmetic import divide
from ..functions.registry import vector as vector_of
from ..plans.scope import Scope
from ..plans.table import ROW, Table, q
from ..plans.values import Atom, Emb, Row
from .scoring import SLICE, as_function, nearest_of, neighbors_of
from .tabular import input_table


def _vectors(table: Table, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Adds ``__x``: an array column as it is, or numbers of several columns; nulls are 0."""
    kinds = dict(table.df.dtypes)
    columns = columns or table.columns
    arrays = [c for c in columns if kinds[c].startswith("array")]
    if arrays:
        return table.df.withColumn("__x", array_to_vector(q(arrays[0]).cast("array<double>"))), arrays[:1]
    numbers = [c for c in columns if kinds[c].split("(")[0] in ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal", "boolean")]
    return table.df.withColumn("__x", array_to_vector(F.array(*[F.coalesce(q(c).cast("int").cast("double") if kinds[c] == "boolean" else q(c).cast("double"), F.lit(0.0)) for c in numbers]))), numbers


def _input_vector(scope: Scope, v, columns: list[str]) -> Column:
    if isinstance(v, Row) and len(v.fields) == 1 and next(iter(v.fields)) in ("embedding", "features"):
        v = next(iter(v.fields.values()))
    if isinstance(v, Row) and not isinstance(v, Emb):
        leaves = v.leaves()
        if set(columns) & set(leaves):
            return F.array(*[F.coalesce(leaves[c].column().cast("double"), F.lit(0.0)) if c in leaves else F.lit(0.0) for c in columns])
    return vector_of(scope, v)


def _distance(x: Column, y: Column, metric: str) -> Column:
    dot = F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    if metric == "cosine":
        nx = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, e: s + e * e))
        ny = F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, e: s + e * e))
        return 1 - divide(dot, nx * ny)
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e))


def _literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def kmeans(engine, trainingData: str, outputDataset: str | None = None, centroidsDataset: str | None = None, functionName: str | None = None, numClusters: int = 10, maxIterations: int = 100, metric: str = "cosine", seed: int = 1, **_: object):  # noqa: N803
    table = input_table(engine, trainingData).with_row_name()
    df, columns = _vectors(table)
    model = K.KMeans(k=numClusters, maxIter=maxIterations, seed=seed, featuresCol="__x", predictionCol="cluster", distanceMeasure="cosine" if metric == "cosine" else "euclidean").fit(df)
    out = model.transform(df).select(q(ROW), "cluster")
    centers = [c.tolist() for c in model.clusterCenters()]
    if outputDataset:
        engine.register(outputDataset, out)
    if centroidsDataset:
        engine.register(centroidsDataset, engine.spark.createDataFrame([(str(i), c) for i, c in enumerate(centers)], f"{ROW} string, center array<double>"))
    if functionName:
        stacked = F.array(*[F.struct(F.lit(i).alias("i"), _literal(c).alias("c")) for i, c in enumerate(centers)])

        def apply(scope, args):
            x = _input_vector(scope, args[0], columns)
            return Row({"cluster": Atom(F.array_min(F.transform(stacked, lambda s: F.struct(_distance(x, s["c"], metric).alias("d"), s["i"].alias("i"))))["i"])})

        engine.functions[functionName] = Function(apply)
    return out


def gaussians(engine, trainingData: str, outputDataset: str | None = None, functionName: str | None = None, numClusters: int = 10, maxIterations: int = 100, seed: int = 1, **_: object):  # noqa: N803
    table = input_table(engine, trainingData).with_row_name()
    df, columns = _vectors(table)
    model = K.GaussianMixture(k=numClusters, maxIter=maxIterations, seed=seed, featuresCol="__x", predictionCol="cluster").fit(df)
    out = model.transform(df).select(q(ROW), "cluster")
    if outputDataset:
        engine.register(outputDataset, out)
    if functionName:
        import numpy as np

        parts = []
        for w, g in zip(model.weights, model.gaussians, strict=True):
            cov = g.cov.toArray() + 1e-9 * np.eye(len(columns) if len(columns) > 1 else g.cov.numRows)
            parts.append((math.log(max(w, 1e-300)) - 0.5 * np.linalg.slogdet(cov)[1], g.mean.toArray(), np.linalg.inv(cov)))

        def apply(scope, args):
            x = _input_vector(scope, args[0], columns)
            scores = []
            for i, (log, mean, inv) in enumerate(parts):
                d = F.zip_with(x, _literal(mean), lambda a, b: a - b)
                rows = F.array(*[F.aggregate(F.zip_with(_literal(r), d, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e) for r in inv])
                m = F.aggregate(F.zip_with(rows, d, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
                scores.append(F.struct((F.lit(float(log)) - 0.5 * m).alias("s"), F.lit(-i).alias("i")))
            return Row({"cluster": Atom(-F.array_max(F.array(*scores))["i"])})

        engine.functions[functionName] = Function(apply)
    return out


def svd(engine, trainingData: str, rowOutputDataset: str | None = None, columnOutputDataset: str | None = None, functionName: str | None = None, numSingularValues: int = 100, **_: object):  # noqa: N803
    """Truncated decomposition; rows of the left and right factors as embeddings."""
    from pyspark.mllib.linalg import Vectors as Old
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    table = input_table(engine, trainingData).with_row_name()
    df, columns = _vectors(table)
    width = len(columns) if not dict(table.df.dtypes)[columns[0]].startswith("array") else df.select(F.size(columns[0])).first()[0]
    k = min(numSingularValues, width)
    # a hash of the name joins factors to rows again; equal names share their vector's place
    indexed = df.select(ROW, vector_to_array("__x").alias("x"), F.shiftrightunsigned(F.xxhash64(ROW), 1).alias("i"))
    rows = indexed.rdd.map(lambda r: IndexedRow(r["i"], Old.dense(r["x"])))
    result = IndexedRowMatrix(rows).computeSVD(k, computeU=True)
    u = engine.spark.createDataFrame(result.U.rows.map(lambda r: (int(r.index), [float(x) for x in r.vector])), "i bigint, embedding array<double>")
    out = indexed.select(ROW, "i").join(u, "i").select(ROW, "embedding")
    values, v = result.s.toArray().tolist(), result.V.toArray()
    if rowOutputDataset:
        engine.register(rowOutputDataset, out)
    if columnOutputDataset:
        names = columns if len(columns) == width else [str(i) for i in range(width)]
        engine.register(columnOutputDataset, engine.spark.createDataFrame([(n, r.tolist()) for n, r in zip(names, v, strict=True)], f"{ROW} string, embedding array<double>"))
    if functionName:
        scaled = [(v[:, j] / (s or 1)).tolist() for j, s in enumerate(values)]

        def apply(scope, args):
            x = _input_vector(scope, args[0], columns)
            return Row({"embedding": Emb(F.array(*[F.aggregate(F.zip_with(x, _literal(c), lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e) for c in scaled]))})

        engine.functions[functionName] = Function(apply)
    return out


def tsne(engine, trainingData: str, rowOutputDataset: str | None = None, numOutputDimensions: int = 2, perplexity: float = 30.0, maxRows: int = 2000, steps: int = 250, seed: int = 1, **_: object):  # noqa: N803
    """Places rows in few dimensions.  The method compares all pairs, so it refuses more than ``maxRows``."""
    import numpy as np

    table = input_table(engine, trainingData).with_row_name()
    df, _c = _vectors(table)
    rows = df.select(ROW, vector_to_array("__x").alias("x")).limit(maxRows + 1).collect()
    if len(rows) > maxRows:
        raise ValueError(f"t-SNE takes at most {maxRows} rows here")
    x = np.array([r["x"] for r in rows])
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    p = np.zeros((n, n))
    target = math.log(max(1.01, min(perplexity, max(1.01, (n - 1) / 3))))
    for i in range(n):
        low, high, beta = 0.0, np.inf, 1.0
        for _i in range(50):
            e = np.exp(-(d[i] - np.delete(d[i], i).min() if n > 1 else 0) * beta)
            e[i] = 0
            s = e.sum() or 1e-12
            h = math.log(s) + beta * (e * (d[i] - np.delete(d[i], i).min())).sum() / s
            if abs(h - target) < 1e-5:
                break
            low, high = (beta, high) if h > target else (low, beta)
            beta = beta * 2 if high == np.inf else (low + high) / 2
        p[i] = e / s
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-2, (n, numOutputDimensions))
    v = np.zeros_like(y)
    for t in range(steps):
        w = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(w, 0)
        g = 4 * (((p * (4 if t < 50 else 1) - w / w.sum()) * w)[:, :, None] * (y[:, None] - y[None])).sum(1)
        v = (0.5 if t < 50 else 0.8) * v - 50 * g
        y = y + v - y.mean(0)
    out = engine.spark.createDataFrame([(r[ROW], [float(a) for a in q_]) for r, q_ in zip(rows, y, strict=True)], f"{ROW} string, embedding array<double>")
    if rowOutputDataset:
        engine.register(rowOutputDataset, out)
    return out


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 10, max_distance: float | None = None, metric: str = "euclidean", block: int = 20_000) -> DataFrame:
    """(query, key, distance, rank): the k nearest rows to each query.  About ``block`` queries at a time, or 32 MB of
    them, go to all tasks, and a task passes on no more than its k best for each of them.  Rows without a vector have
    no distance and come last."""
    spark = vectors.sparkSession
    known = lambda c: q(c).isNotNull() & ~F.exists(q(c), lambda x: x.isNull())
    asked = queries.where(known(vector)).select(q(key).alias("query"), q(vector).cast("array<double>").alias("v"))
    n, size = asked.agg(F.count("*"), F.sum(8.0 * F.size("v"))).first()
    blocks = max(1, -(-n // block), math.ceil((size or 0) / SLICE))
    # rows are dealt to all cores, however few files they come from; of equally near ones a task keeps the first keys
    points = vectors.where(known(vector)).select(q(key), q(vector).cast("array<double>").alias("v")).repartition(2 * spark.sparkContext.defaultParallelism).sortWithinPartitions(q(key))
    kinds = T.StructType([T.StructField("query", asked.schema["query"].dataType), T.StructField(key, points.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    best = Window.partitionBy("query").orderBy(F.asc_nulls_last("distance"), q(key))
    out = None
    for b in range(blocks if n else 0):
        some = asked.where(F.pmod(F.xxhash64("query", "v"), F.lit(blocks)) == b) if blocks > 1 else asked
        part = points.mapInArrow(nearest_of(spark, some.toArrow(), k, metric), kinds)
        if max_distance is not None:
            part = part.where(F.col("distance") <= max_distance)
        out = part if out is None else out.union(part)
    if max_distance is None:
        # pairs without a distance: the first rows for queries without a vector, and the first rows without one for all
        pairs = lambda some, rows: some.select(q(key).alias("query")).crossJoin(F.broadcast(rows.select(q(key)).orderBy(q(key)).limit(k))).select("query", q(key), F.lit(None).cast("double").alias("distance"))
        never = ~F.coalesce(known(vector), F.lit(False))
        missing = pairs(queries.where(never), vectors).union(pairs(queries.where(known(vector)), vectors.where(never)))
        out = missing if out is None else out.union(missing)
    if out is None:
        out = spark.createDataFrame([], kinds)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def neighbors(engine, dataset: str, functionName: str | None = None, vectorColumn: str | None = None, numNeighbors: int = 10, maxDistance: float | None = None, metric: str = "euclidean", queries: str | None = None, **_: object):  # noqa: N803
    """Nearest neighbours: for a table of queries, and as a function of one vector."""
    table = engine.table(dataset).with_row_name()
    column = vectorColumn or next(c for c, k in table.df.dtypes if k.startswith("array"))
    if functionName:

        def apply(scope, args):
            """The neighbours of each row's vector, or of the named row."""
            v = args[0].fields
            if isinstance(v["coords"], (Emb, Row)):
                coords = vector_of(scope, v["coords"])
            else:
                name = v["coords"].const
                coords = _literal(table.df.where(q(ROW) == str(name)).select(q(column)).first()[0])
            k = int(v["numNeighbors"].const) if "numNeighbors" in v else numNeighbors
            most = v["maxDistance"].const if "maxDistance" in v else maxDistance
            find = engine.functions[functionName].state.get("find")
            if find is None:
                rows = table.df.where(q(column).isNotNull()).select(q(ROW).cast("string").alias("r"), q(column).cast("array<double>").alias("v"))
                find = engine.functions[functionName].state["find"] = neighbors_of(rows, metric)
            found = find(coords, k, most)
            return Row({"neighbors": Emb(found["neighbors"]), "distances": Emb(found["distances"])})

        engine.functions[functionName] = Function(apply)
    if queries is None:
        return None
    qt = input_table(engine, queries).with_row_name()
    return nearest(table.df, ROW, column, qt.df, numNeighbors, maxDistance, metric)


# classifiers: the settings' names are fixed values

#: Links between a linear score and the chance of true, as families of generalised linear models.
LINKS = {
    "logit": {"family": "binomial", "link": "logit"}, "probit": {"family": "binomial", "link": "probit"}, "comp_log_log": {"family": "binomial", "link": "cloglog"},
    "linear": {"family": "gaussian", "link": "identity"}, "log": {"family": "poisson", "link": "log"},
}


def _estimator(conf: dict, mode: str, classes: int):
    kind = conf.get("type", "glz")
    common = {"featuresCol": "__x", "labelCol": "__y"}
    depth, trees = conf.get("max_depth", 5), conf.get("num_bags", conf.get("iterations", 20))
    regression = mode == "regression"
    if kind in ("decision_tree", "stump"):
        depth = 1 if kind == "stump" else min(30, depth if depth > 0 else 10)
        return (R.DecisionTreeRegressor if regression else C.DecisionTreeClassifier)(maxDepth=depth, seed=1, **common)
    if kind == "bagging":
        return (R.RandomForestRegressor if regression else C.RandomForestClassifier)(numTrees=trees, maxDepth=min(30, conf.get("weak_learner", {}).get("max_depth", depth)), seed=1, **common)
    if kind in ("boosting", "boosted_stumps"):
        if regression or classes == 2:
            return (R.GBTRegressor if regression else C.GBTClassifier)(maxIter=conf.get("max_iterations", 20), maxDepth=1 if kind == "boosted_stumps" else depth, seed=1, **common)
        return C.OneVsRest(classifier=_estimator(conf, mode, 2), **common)
    if kind == "glz":
        reg = conf.get("regularization_factor", 1e-5)
        link = conf.get("link_function", "logit")
        if link not in LINKS:
            raise QueryError(f"unknown link function {link!r}")
        if link != "logit" and not regression:
            if classes != 2:
                raise QueryError("links other than logit are for two classes")
            return R.GeneralizedLinearRegression(regParam=reg, predictionCol="prediction", maxIter=50, **LINKS[link], **common)
        if regression:
            return R.GeneralizedLinearRegression(regParam=reg, family="gaussian", **common)
        return C.LogisticRegression(regParam=reg, **common)
    if kind == "naive_bayes":
        return C.NaiveBayes(modelType="gaussian", **common)
    if kind == "perceptron":
        return C.MultilayerPerceptronClassifier(layers=[conf["inputs"], *conf.get("hidden", [8]), classes], seed=1, **common)
    if kind == "svm":
        return C.LinearSVC(regParam=conf.get("regularization_factor", 1e-3), **common)
    if kind == "onevsall":
        return C.OneVsRest(classifier=_estimator(conf.get("weak_classifier", {"type": "glz"}), "boolean", 2), **common)
    if kind == "fasttext":
        return C.LogisticRegression(regParam=1e-4, **common)
    raise ValueError(f"unknown classifier {kind!r}")


class Classifier:
    """A trained model with the columns and classes it knows."""

    def __init__(self, model, columns: list[str], classes: list[str] | None, mode: str):
        self.model, self.columns, self.classes, self.mode = model, columns, classes, mode

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``score``: the chance of true, the value, or chances by class."""
        if self.model is None:
            return df.withColumn("score", F.lit(0.0))
        if isinstance(self.model, C.OneVsRestModel):  # its own transform knows no names with points
            p = as_function(df.sparkSession, self.model)(vector_to_array("__x"))
            return df.withColumn("score", p[1] if self.mode == "boolean" else F.map_from_arrays(F.array(*map(F.lit, self.classes)), p))
        out = self.model.transform(df)
        if self.mode == "regression" or self.mode == "boolean" and isinstance(self.model, R.GeneralizedLinearRegressionModel):
            return out.withColumn("score", F.col("prediction"))
        if "probability" in out.columns:
            p = vector_to_array("probability")
        elif "rawPrediction" in out.columns:
            p = F.transform(vector_to_array("rawPrediction"), lambda r: 1 / (1 + F.exp(-r)))
        else:
            p = F.transform(F.sequence(F.lit(0), F.lit(len(self.classes) - 1)), lambda i: (F.col("prediction") == i).cast("double"))
        if self.mode == "boolean":
            return out.withColumn("score", p[1])
        return out.withColumn("score", F.map_from_arrays(F.array(*map(F.lit, self.classes)), p))


def _training(engine, data: str) -> tuple[Table, DataFrame, list[str]]:
    table = input_table(engine, data).with_row_name()
    features = [c for c in table.columns if c == "features" or c.startswith("features.")]
    df, columns = _vectors(Table(table.df), features)
    return table, df, columns


def classifier(engine, trainingData: str, functionName: str | None = None, algorithm: str = "", configuration: dict | None = None, mode: str = "boolean", **_: object) -> Classifier:  # noqa: N803
    """Trains on {features..., label}: boolean, categorical or regression."""
    table, df, columns = _training(engine, trainingData)
    conf = configuration or {"dt": {"type": "decision_tree"}, "bdt": {"type": "boosting"}, "bglz": {"type": "glz"}, "glz": {"type": "glz"}, "bbdt": {"type": "bagging"}, "naive_bayes": {"type": "naive_bayes"}, "svm": {"type": "svm"}}.get(algorithm, {"type": algorithm or "glz"})
    classes = None
    if mode == "regression":
        df = df.withColumn("__y", q("label").cast("double"))
    elif mode == "boolean":
        df = df.withColumn("__y", q("label").cast("boolean").cast("int").cast("double"))
        classes = ["0", "1"]
    else:
        indexer = StringIndexer(inputCol="__l", outputCol="__y", stringOrderType="alphabetAsc").fit(df.withColumn("__l", q("label").cast("string")))
        df, classes = indexer.transform(df.withColumn("__l", q("label").cast("string"))), indexer.labels
    df = df.where("__y is not null")
    if conf.get("type") == "null":
        model = None
    else:
        if conf.get("type") == "perceptron":
            conf = conf | {"inputs": df.select("__x").first()[0].size}
        model = _estimator(conf, mode, len(classes or [0, 1])).fit(df.select("__x", "__y"))
    out = Classifier(model, columns, classes, mode)
    if functionName:
        engine.functions[functionName] = Function(_scorer(engine, out))
    return out


def _scorer(engine, model: Classifier):
    """Linear models become column arithmetic; others a function over batches of rows."""
    state: dict = {}

    def apply(scope, args):
        x = _input_vector(scope, args[0].fields.get("features", args[0]) if isinstance(args[0], Row) else args[0], [c.removeprefix("features.") for c in model.columns])
        inner = model.model
        if inner is None:
            return Row({"score": Atom(F.lit(0.0))})
        linked = model.mode == "boolean" and isinstance(inner, R.GeneralizedLinearRegressionModel)
        if model.mode != "categorical" and hasattr(inner, "coefficients") and not linked:
            dot = F.aggregate(F.zip_with(x, _literal(inner.coefficients.toArray()), lambda a, b: a * b), F.lit(float(inner.intercept)), lambda s, e: s + e)
            return Row({"score": Atom(dot if model.mode == "regression" else 1 / (1 + F.exp(-dot)))})
        if "f" not in state:
            state["f"] = as_function(engine.spark, inner)
        chances = state["f"](x)
        if model.mode == "categorical":
            return Row({"scores": Row({c: Atom(F.get(chances, F.lit(i))) for i, c in enumerate(model.classes)})})
        return Row({"score": Atom(F.get(chances, F.lit(0 if model.mode == "regression" else 1)))})

    return apply


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The area under the curve of a boolean classifier, ties halved, from counts by score."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    df = scored.select(q(label).cast("boolean").cast("int").cast("double").alias("label"), q(score).cast("double").alias("raw"))
    value = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", metricName="areaUnderROC").evaluate(df)
    return scored.sparkSession.createDataFrame([(float(value),)], "auc double")


def test(engine, testingData: str, mode: str = "boolean", outputDataset: str | None = None, threshold: float = 0.5, **_: object) -> DataFrame:  # noqa: N803
    """Metrics of {score, label}."""
    table = input_table(engine, testingData)
    df = table.df
    if mode == "regression":
        e = q("score").cast("double") - q("label").cast("double")
        y = q("label").cast("double")
        out = df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"))
    elif mode == "boolean":
        yes, said = q("label").cast("boolean"), q("score").cast("double") >= threshold
        n = lambda c: F.sum(c.cast("long"))
        out = df.agg(n(yes & said).alias("tp"), n(~yes & said).alias("fp"), n(~yes & ~said).alias("tn"), n(yes & ~said).alias("fn"))
        out = out.select("*", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"), ((F.col("tp") + F.col("tn")) / F.expr("tp + fp + tn + fn")).alias("accuracy"))
        out = out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))).crossJoin(auc(df))
    else:
        guess = q("score") if not dict(df.dtypes)["score"].startswith("map") else F.array_max(F.transform(F.map_entries(q("score")), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))["k"]
        out = df.select(q("label").cast("string").alias("actual"), guess.cast("string").alias("predicted")).groupBy("actual", "predicted").agg(F.count("*").alias("count"))
    if outputDataset:
        engine.register(outputDataset, out)
    return out


def experiment(engine, inputData: str, mode: str = "boolean", configuration: dict | None = None, algorithm: str = "glz", kfold: int = 2, experimentName: str = "exp", **_: object) -> list[DataFrame]:  # noqa: N803
    """Trains and tests on folds by the hash of row names."""
    table, df, columns = _training(engine, inputData)
    fold = F.pmod(F.xxhash64(q(ROW)), F.lit(kfold))
    out = []
    for k in range(kfold):
        name = f"__{experimentName}_{k}"
        engine.register(name, Table(table.df.where(fold != k)))
        model = classifier(engine, name, configuration=configuration, algorithm=algorithm, mode=mode)
        scored = model.score(df.where(fold == k)).select("score", "label")
        engine.register(name, Table(scored))
        out.append(test(engine, name, mode))
        del engine.tables[name]
    return out


def forest(engine, trainingData: str, functionName: str | None = None, featureVectorSamplings: int = 5, featureSamplings: int = 20, maxDepth: int = 20, **_: object) -> Classifier:  # noqa: N803
    """A tree for each sampling of rows and each of features; Spark's trees have at most 30 levels."""
    return classifier(engine, trainingData, functionName, configuration={"type": "bagging", "num_bags": featureVectorSamplings * featureSamplings, "weak_learner": {"max_depth": min(maxDepth, 30)}}, mode="boolean")


def svm(engine, trainingData: str, functionName: str | None = None, **_: object) -> Classifier:  # noqa: N803
    return classifier(engine, trainingData, functionName, configuration={"type": "svm"}, mode="boolean")


def probabilizer(engine, trainingData: str, functionName: str | None = None, link: str = "logit", **_: object):  # noqa: N803
    """Fits a curve from scores to chances, on (score, label)."""
    table = input_table(engine, trainingData)
    df = table.df.select(F.array(q("score").cast("double")).alias("s"), q("label").cast("boolean").cast("int").cast("double").alias("__y")).withColumn("__x", array_to_vector("s"))
    if link not in LINKS:
        raise QueryError(f"unknown link function {link!r}")
    plain = link == "logit"
    model = (C.LogisticRegression(featuresCol="__x", labelCol="__y") if plain else R.GeneralizedLinearRegression(featuresCol="__x", labelCol="__y", maxIter=50, **LINKS[link])).fit(df.select("__x", "__y").where("__y is not null"))
    slope, intercept = float(model.coefficients[0]), float(model.intercept)
    if functionName:
        curve = None if plain else as_function(engine.spark, model)

        def apply(scope, args):
            x = args[0].fields["score"].column().cast("double")
            return Row({"prob": Atom(1 / (1 + F.exp(-(x * slope + intercept))) if plain else F.get(curve(F.array(x)), F.lit(1)))})

        engine.functions[functionName] = Function(apply)
    return {"slope": slope, "intercept": intercept}

