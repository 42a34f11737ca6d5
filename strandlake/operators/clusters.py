"""Peaks by motifs as sparse vectors, and clusters in an order in which neighbours are alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Motifs that a matrix may have; their names go to every task.
MOST_MOTIFS = 1 << 16


def motif_names(hits: DataFrame, column: str = "key") -> list[str]:
    """The motifs in order: a dictionary of bounded size."""
    found = [r[0] for r in hits.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_MOTIFS + 1).collect()]
    if len(found) > MOST_MOTIFS:
        raise ValueError(f"over {MOST_MOTIFS} motifs")
    return sorted(found)


def motif_matrix(hits: DataFrame, peaks: DataFrame, motifs: list[str], name: str = "counts") -> DataFrame:
    """peaks (peak, ...) with a sparse vector: how many hits (peak, key) of each motif it has. Peaks without hits have zero vectors, hits of other motifs don't count.

    Hits are counted by peak and motif before they meet. Vectors are made by Spark ML from a fixed vocabulary.
    """
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import array_to_vector

    if not motifs:
        return peaks.withColumn(name, array_to_vector(F.array().cast("array<double>")))
    n = hits.groupBy("peak", F.col("key").cast("string").alias("key")).agg(F.count("*").cast("int").alias("_n"))
    words = n.groupBy("peak").agg(F.flatten(F.collect_list(F.array_repeat("key", F.col("_n")))).alias("_words"))
    rows = peaks.join(words, "peak", "left").withColumn("_words", F.coalesce("_words", F.array().cast("array<string>")))
    return CountVectorizerModel.from_vocabulary(motifs, "_words", name).transform(rows).drop("_words")


def cells(matrix: DataFrame, motifs: list[str], name: str = "counts") -> DataFrame:
    """peak, key, n: the matrix's cells other than 0."""
    from pyspark.ml.functions import vector_to_array

    names = F.array(*map(F.lit, motifs)).cast("array<string>")
    each = matrix.select("peak", F.posexplode(vector_to_array(name)).alias("_i", "n")).filter("n <> 0")
    return each.select("peak", F.get(names, F.col("_i")).alias("key"), F.col("n").cast("long").alias("n"))


def linkage(centres: np.ndarray) -> list[tuple[int, int]]:
    """Centroid linkage: the two nearest clusters merge, again and again, and stand at their points' mean. Numbers from len(centres) on are the merged ones; ties go to the earlier pair."""
    at = {i: (np.asarray(c, float), 1) for i, c in enumerate(centres)}
    out = []
    while len(at) > 1:
        ids = sorted(at)
        _, a, b = min((float(((at[i][0] - at[j][0]) ** 2).sum()), i, j) for k, i in enumerate(ids) for j in ids[k + 1 :])
        (x, n), (y, m) = at.pop(a), at.pop(b)
        at[len(centres) + len(out)] = ((x * n + y * m) / (n + m), n + m)
        out.append((a, b))
    return out


def leaf_order(centres: np.ndarray, merges: list[tuple[int, int]]) -> list[int]:
    """The order of leaves that the tree allows in which neighbours' distances add up to the least, by dynamic programming over the ends of each subtree; ties go to the order that comes first."""
    n = len(centres)
    if not n:
        return []
    far = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
    # best[node][left, right]: least cost of an order of the node's leaves with these ends, and that order
    best: dict[int, dict[tuple[int, int], tuple[float, tuple[int, ...]]]] = {i: {(i, i): (0.0, (i,))} for i in range(n)}
    for k, (a, b) in enumerate(merges):
        found: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}
        for x, y in ((a, b), (b, a)):
            for (p, q), (cost, order) in best[x].items():
                for (r, s), (more, rest) in best[y].items():
                    new = (cost + far[q, r] + more, order + rest)
                    if (p, s) not in found or (round(new[0], 12), new[1]) < (round(found[p, s][0], 12), found[p, s][1]):
                        found[p, s] = new
        best[n + k] = found
        del best[a], best[b]
    return list(min(best[n + len(merges) - 1 if merges else 0].values(), key=lambda c: (round(c[0], 12), c[1]))[1])


def cluster_order(centres: np.ndarray) -> list[int]:
    """Clusters by centroid linkage and the best order of its leaves; few centres, on the driver."""
    centres = np.asarray(centres, float)
    return leaf_order(centres, linkage(centres))


def clustered(df: DataFrame, features: str, k: int, seed: int = 1, rounds: int = 20) -> DataFrame:
    """df with cluster (k-means) and place: the cluster's place in cluster_order(). Sorting by place and an id puts like rows together; one distinct row needs no clusters."""
    from pyspark.ml.clustering import KMeans

    distinct = df.select(features).distinct().limit(k).count()
    if distinct <= 1:
        return df.withColumns({"cluster": F.lit(0), "place": F.lit(0)})
    model = KMeans(k=min(k, distinct), seed=seed, maxIter=rounds, featuresCol=features, predictionCol="cluster").fit(df)
    order = cluster_order(np.array(model.clusterCenters()))
    place = [order.index(i) for i in range(len(order))]
    return model.transform(df).withColumn("place", F.get(F.array(*map(F.lit, place)), F.col("cluster")))
