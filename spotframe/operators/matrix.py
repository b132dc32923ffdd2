"""Feature matrices: principal components, clusters, neighbours and communities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotframe.session import cut


def principal_components(df: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """``ident``, ``pc``: projections of the centred vectors; each component's largest weight is positive."""
    rows = df.select(ident, F.col(vector).cast("array<double>").alias("_v")).where(F.col(vector).isNotNull())
    n = len(rows.first()["_v"])
    means = rows.agg(*[F.avg(F.col("_v")[i]).alias(str(i)) for i in range(n)]).first()
    centred = rows.select(ident, array_to_vector(F.zip_with("_v", F.array(*[F.lit(float(m)) for m in means]), lambda a, b: a - b)).alias("_c"))
    model = PCA(k=min(k, n), inputCol="_c", outputCol="_p").fit(centred)
    weights = model.pc.toArray()
    sign = [1.0 if weights[np.abs(weights[:, j]).argmax(), j] > 0 else -1.0 for j in range(weights.shape[1])]
    return model.transform(centred).select(ident, F.zip_with(vector_to_array("_p"), F.array(*[F.lit(s) for s in sign]), lambda a, b: a * b).alias("pc"))


def kmeans_tokens(df: DataFrame, ident: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """``ident``, ``cluster`` (STRING) by k-means with k-means|| starts."""
    rows = df.where(F.col(vector).isNotNull()).select(ident, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c", initSteps=5).fit(rows)
    return model.transform(rows).select(ident, F.col("_c").cast("string").alias("cluster"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all of ``b``, dimension by dimension, so a pair's doesn't depend on its batch."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(out)


def nearest_vectors(df: DataFrame, queries: DataFrame, ident: str, vector: str, k: int, block_rows: int = 20_000) -> DataFrame:
    """``query``, ``neighbour``, ``distance``, ``rank``: the exact k nearest of a stated query set among all rows.

    The queries go out in broadcast blocks of at most ``block_rows``; every task keeps the k
    best of its rows for each query, and the bests are merged. A query is not its own neighbour.
    """
    spark = df.sparkSession
    ask = queries.select(F.col(ident).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    n = ask.count()
    blocks = max(1, -(-n // block_rows))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    parts = None
    for b in range(blocks):
        some = ask.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").collect()
        if not some:
            continue
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in some]), np.array([r[1] for r in some])))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, "int64")
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = batch.column(0).to_numpy()
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                for s in range(0, len(ids), 256):
                    e = min(s + 256, len(ids))
                    d = distances(q[s:e], x)
                    d[ids[s:e, None] == own[None]] = np.inf
                    d, i = np.hstack([best_d[s:e], d]), np.hstack([best_i[s:e], np.broadcast_to(own, (e - s, len(own)))])
                    o = np.lexsort((i, d), axis=1)[:, :k]
                    best_d[s:e], best_i[s:e] = np.take_along_axis(d, o, 1), np.take_along_axis(i, o, 1)
            ok = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k).reshape(-1, k)[ok]), pa.array(best_i[ok]), pa.array(best_d[ok])], names=["query", "neighbour", "distance"])

        part = rows.mapInArrow(scan, "query long, neighbour long, distance double")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], "query long, neighbour long, distance double, rank int")
    w = Window.partitionBy("query").orderBy("distance", "neighbour")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def connected_labels(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node of each connected set of an undirected edge table (``a``, ``b``).

    Rounds of taking the smallest neighbouring label and jumping to the label's own label; the
    driver sees one count per round; labels only fall, so the rounds end. The table of labels
    isn't broadcast: rows with few different labels are many times their file's size in memory.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near.hint("merge"), "node").select("node", F.least("label", "m").alias("new"), "label")
        jump = step.join(labels.select(F.col("node").alias("new"), F.col("label").alias("far")).hint("merge"), "new", "left")
        nxt = cut(jump.select("node", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("moved")))
        moved = nxt.where("moved").isEmpty()
        labels = nxt.select("node", "label")
        if moved:
            return labels


def propagated_labels(nodes: DataFrame, edges: DataFrame, halves: int = 20) -> DataFrame:
    """``node``, ``label``: communities of an undirected edge table (``a``, ``b``) by label propagation; a node without an edge is its own.

    A node wants the label that most of its neighbours have (of equals, one by hash), if those are
    more than have its own. In the first ``halves`` rounds half of those that want move, by hash;
    then only those before whose neighbours none comes by hash, so that each move joins more edges
    than it parts and the rounds end by themselves. The driver sees only whether any
    wants to move.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(nodes.select(F.col("node").cast("long")).distinct().withColumn("label", F.col("node")))
    turn = 0
    while True:
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), F.col("label").alias("seen")).agg(F.count("*").alias("n"))
        top = F.max(F.struct("n", F.xxhash64("node", "seen").alias("tie"), "seen")).alias("top")
        best = votes.join(labels, "node").groupBy("node").agg(top, F.coalesce(F.max(F.when(F.col("seen") == F.col("label"), F.col("n"))), F.lit(0)).alias("own"))
        want = cut(best.where("top.n > own").select("node", F.col("top.seen").alias("new"), F.struct(F.xxhash64("node", F.lit(turn)).alias("hash"), "node").alias("order")))
        if want.isEmpty():
            return labels
        if turn < halves:
            want = want.where("order.hash >= 0")
        else:
            near = both.join(want.select(F.col("node").alias("b"), F.col("order").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
            want = want.join(near, "node", "left").where("other IS NULL OR order < other")
        labels = cut(labels.join(want.select("node", "new"), "node", "left").select("node", F.coalesce("new", "label").alias("label")))
        turn += 1
