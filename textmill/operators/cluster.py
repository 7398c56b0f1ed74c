"""Clustering: k-means, principal components, silhouettes; linkage and consensus trees of small sets of documents."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators import blocks

#: Distances of one vector to the rows of a matrix.
METRICS = {
    "euclidean": lambda v, x: np.sqrt(((x - v) ** 2).sum(1)),
    "cosine": lambda v, x: 1 - (x * v).sum(1) / np.sqrt((x * x).sum(1) * (v * v).sum()),
    "cityblock": lambda v, x: np.abs(x - v).sum(1),
}
#: Rows of a distance matrix that may come to the driver.
MOST_TREE_ROWS = 5000


def vectors(rows: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return rows.withColumn(out, array_to_vector(F.transform(array_col, lambda x: x.cast("double"))))


def feature_arrays(feats: DataFrame, value: str = "freq") -> DataFrame:
    """doc_id, values: long features (doc_id, term, value) as arrays in order of term."""
    return feats.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("term", F.col(value).alias("x")))), lambda s: s["x"]).alias("values"))


def kmeans(rows: DataFrame, k: int = 2, *, seed: int = 42, max_iter: int = 300, tol: float = 1e-4, array_col: str = "values", init: str = "k-means||", n_init: int = 10):
    """The rows with their cluster, and the model: the best of ``n_init`` starts by inertia, the first of equal ones."""
    v = vectors(rows, array_col)
    v.persist()
    try:
        models = [KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=tol, initMode=init).fit(v) for i in range(n_init)]
        model = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        v.unpersist()
    return model.transform(v).withColumnRenamed("prediction", "cluster").drop("features"), model


def elbow(rows: DataFrame, ks: range, *, seed: int = 42, array_col: str = "values") -> tuple[list[tuple[int, float]], int]:
    """Inertia of each k, and the k farthest from the line between the ends."""
    v = vectors(rows, array_col).select("features").cache()
    try:
        points = [(k, KMeans(k=k, seed=seed).fit(v).summary.trainingCost) for k in ks]
    finally:
        v.unpersist()
    (x0, y0), (x1, y1) = points[0], points[-1]
    far = [abs((y1 - y0) * x - (x1 - x0) * y + x1 * y0 - y1 * x0) / max(math.hypot(y1 - y0, x1 - x0), 1e-12) for x, y in points]
    return points, points[int(np.argmax(far))][0]


def pca(rows: DataFrame, dims: int = 2, *, array_col: str = "values") -> DataFrame:
    """Rows with pc1, pc2 and so on."""
    model = PCA(k=dims, inputCol="features", outputCol="__pc").fit(v := vectors(rows, array_col))
    out = model.transform(v).withColumn("__pc", vector_to_array("__pc"))
    return out.select(*rows.columns, *[F.col("__pc")[i].alias(f"pc{i + 1}") for i in range(dims)])


def silhouette(clustered: DataFrame, *, array_col: str = "values") -> float:
    """Mean silhouette by squared distances, which needs only sums per cluster."""
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(vectors(clustered, array_col))


def silhouette_values(clustered: DataFrame, *, array_col: str = "values") -> DataFrame:
    """The rows with their own silhouette, by squared distances.

    The mean squared distance of a row to a cluster follows from the cluster's size,
    mean and mean square: k rows go to all others, and no pair is made.  Rows alone in
    their cluster have 0.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    own = clustered.withColumn("__v", F.transform(array_col, lambda x: x.cast("double"))).withColumn("__q", dot("__v", "__v"))
    sums = own.select("cluster", "__q", F.posexplode("__v").alias("i", "x")).groupBy("cluster", "i").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.avg("__q").alias("q"))
    about = sums.groupBy("cluster").agg(F.first("n").alias("n"), F.first("q").alias("q"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    every = F.broadcast(about.agg(F.collect_list(F.struct("cluster", "n", "q", "m")).alias("__c")))
    met = own.crossJoin(every).withColumn("__d", F.transform("__c", lambda c: F.struct(c["cluster"].alias("c"), c["n"].alias("n"), (F.col("__q") + c["q"] - 2 * dot(F.col("__v"), c["m"])).alias("d"))))
    mine = F.filter("__d", lambda d: d["c"] == F.col("cluster"))[0]
    inner, outer = mine["d"] * mine["n"] / (mine["n"] - 1), F.array_min(F.transform(F.filter("__d", lambda d: d["c"] != F.col("cluster")), lambda d: d["d"]))
    value = F.when((mine["n"] == 1) | outer.isNull(), 0.0).otherwise((outer - inner) / F.greatest(inner, outer))
    return met.withColumn("silhouette", F.coalesce(value, F.lit(0.0))).select(*clustered.columns, "silhouette")


def distances(rows: DataFrame, queries: DataFrame, *, metric: str = "euclidean", id_col: str = "doc_id", array_col: str = "values") -> DataFrame:
    """query_id, doc_id, distance of stated query rows to all rows: the queries go through in blocks of a bounded size."""
    vec = lambda d: d.select(F.col(id_col).alias("doc_id"), F.transform(array_col, lambda x: x.cast("double")).alias("v"))
    return blocks.against(vec(rows), vec(queries), METRICS[metric], "distance")


def to_matrix(rows: DataFrame, *, id_col: str = "doc_id", array_col: str = "values") -> tuple[list, np.ndarray]:
    """Ids and matrix of a small set of rows, checked against the bound."""
    got = rows.select(id_col, array_col).orderBy(id_col).limit(MOST_TREE_ROWS + 1).collect()
    if len(got) > MOST_TREE_ROWS:
        raise ValueError(f"trees are for at most {MOST_TREE_ROWS} rows; cluster first")
    return [r[0] for r in got], np.array([r[1] for r in got], float)


def pairwise(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.clip(1 - (x @ x.T) / np.maximum(n * n.T, 1e-12), 0, None)
    if metric == "cityblock":
        return np.abs(x[:, None] - x[None]).sum(-1)
    s = (x * x).sum(1)
    return np.sqrt(np.clip(s[:, None] + s[None] - 2 * x @ x.T, 0, None))


def linkage(d: np.ndarray, method: str = "average") -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) by the update rules of Lance and Williams."""
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, live, out = [1] * n, list(range(n)), list(range(n)), []
    for step in range(n - 1):
        sub = d[np.ix_(live, live)]
        i, j = divmod(int(np.argmin(sub)), len(live))
        a, b = sorted((live[i], live[j]))
        h, na, nb = d[a, b], size[a], size[b]
        out.append((*sorted((name[a], name[b])), float(h), na + nb))
        for k in live:
            if k in (a, b):
                continue
            x, y, nk = d[a, k], d[b, k], size[k]
            new = {
                "single": min(x, y),
                "complete": max(x, y),
                "average": (na * x + nb * y) / (na + nb),
                "weighted": (x + y) / 2,
                "ward": math.sqrt(max(0.0, ((na + nk) * x * x + (nb + nk) * y * y - nk * h * h) / (na + nb + nk))),
            }[method]
            d[a, k] = d[k, a] = new
        size[a], name[a] = na + nb, n + step
        live.remove(b)
    return out


def newick(merges: list[tuple[int, int, float, int]], labels: list[str]) -> str:
    """The tree of merges with branch lengths."""
    text, height = dict(enumerate(map(str, labels))), dict.fromkeys(range(len(labels)), 0.0)
    n = len(labels)
    for i, (a, b, h, _) in enumerate(merges):
        text[n + i] = f"({text[a]}:{(h - height[a]) / 2:.6f},{text[b]}:{(h - height[b]) / 2:.6f})"
        height[n + i] = h
    return text[n + len(merges) - 1] + ";"


def clades(merges: list[tuple[int, int, float, int]], n: int) -> list[frozenset[int]]:
    held = {i: frozenset([i]) for i in range(n)}
    for i, (a, b, _, _) in enumerate(merges):
        held[n + i] = held[a] | held[b]
    return [held[n + i] for i in range(len(merges))]


def consensus(x: np.ndarray, *, rounds: int = 100, share: float = 0.8, cutoff: float = 0.5, method: str = "average", metric: str = "euclidean", seed: int = 42) -> list[tuple[frozenset[int], float]]:
    """Clades that occur in more than ``cutoff`` of trees on samples of the features, with their support."""
    rng, seen = np.random.default_rng(seed), {}
    for _ in range(rounds):
        cols = rng.choice(x.shape[1], max(1, int(share * x.shape[1])), replace=False)
        for c in clades(linkage(pairwise(x[:, cols], metric), method), len(x)):
            seen[c] = seen.get(c, 0) + 1
    return sorted(((c, k / rounds) for c, k in seen.items() if k / rounds > cutoff), key=lambda s: (len(s[0]), sorted(s[0])))
