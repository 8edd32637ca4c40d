"""Row-wise similarity, effect metrics and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalars import EPS, cosine, pearson, ratio


def average_rank(over: list[str], value: str) -> Column:
    """Rank of a value in its group, ties sharing their mean rank."""
    peers = F.count(F.lit(1)).over(Window.partitionBy(*over, value))
    return F.rank().over(Window.partitionBy(*over).orderBy(value)) + (peers - 1) / 2


def row_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per row of two vectors x and y in long form: Pearson, cosine, mean squared error, energy explained, norm ratio."""
    x, y = F.col("x"), F.col("y")
    err = F.sum((x - y) * (x - y))
    return pairs.groupBy(*keys).agg(
        pearson(x, y).alias("pearson"),
        cosine(x, y).alias("cosine"),
        (err / F.count(F.lit(1))).alias("mse"),
        (1 - ratio(err, F.sum(y * y), EPS)).alias("energy_explained"),
        F.sqrt(ratio(F.sum(x * x), F.sum(y * y), EPS)).alias("norm_ratio"),
    )


def row_spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    ranked = pairs.withColumns({"rx": average_rank(keys, "x"), "ry": average_rank(keys, "y")})
    return ranked.groupBy(*keys).agg(pearson(F.col("rx"), F.col("ry")).alias("spearman"))


def pairs_within(vectors: DataFrame, group: list[str], axis: str, element: str, value: str) -> DataFrame:
    """Both values of every pair of `axis` labels of a group, element by element.

    Meant for short axes (contexts, sources): a group's pairs grow with the square of its labels, not with its elements.
    """
    left = vectors.select(*group, element, F.col(axis).alias("a"), F.col(value).alias("x"))
    right = vectors.select(*group, element, F.col(axis).alias("b"), F.col(value).alias("y"))
    return left.join(right, [*group, element]).filter("a < b")


def agreement(vectors: DataFrame, group: list[str], axis: str, element: str, value: str) -> DataFrame:
    """Mean over pairs of sources of their Pearson over elements; pairs without one are left out."""
    each = pairs_within(vectors, group, axis, element, value).groupBy(*group, "a", "b").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    return each.groupBy(*group).agg(F.avg("r").alias("agreement"), F.count("r").alias("n_pairs"))


def packed_cosine(query: DataFrame, reference: DataFrame) -> DataFrame:
    """Cosines of packed vectors (id, vec) of a stated query set against reference vectors: query_id, ref_id, cos.

    Norms are divided out once for each vector. The query set is the small, stated side and is joined as such.
    """

    def unit(df: DataFrame, name: str) -> DataFrame:
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
        return df.select(F.col("id").alias(name), F.transform("vec", lambda v: F.when(norm > 0, v / norm).otherwise(0.0)).alias(f"{name}_v"))

    both = unit(reference, "ref_id").crossJoin(unit(query, "query_id"))
    dot = F.aggregate(F.zip_with("query_id_v", "ref_id_v", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return both.select("query_id", "ref_id", dot.alias("cos"))


def nearest(cosines: DataFrame, k: int) -> DataFrame:
    """The k references with the largest (rounded) cosine of each query, ties by id: adds position."""
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "ref_id")
    return cosines.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def knn_predict(neighbours: DataFrame, values: DataFrame) -> DataFrame:
    """Mean of the neighbours' values, weighted by cosine; negative weights count as zero, without any weight the result is 0."""
    w = F.greatest("cos", F.lit(0.0))
    joined = neighbours.join(values, "ref_id")
    return joined.groupBy("query_id").agg(F.coalesce(ratio(F.sum(w * F.col("value")), F.sum(w)), F.lit(0.0)).alias("predicted"))


def discrimination(cosines: DataFrame) -> DataFrame:
    """Per row: 1 - (closer + half of the other ties) / (n - 1) of its own match among all candidates, on 1 - cos."""
    own = F.max(F.when(F.col("query_id") == F.col("ref_id"), 1 - F.col("cos"))).over(Window.partitionBy("query_id"))
    d = cosines.withColumn("d", 1 - F.col("cos")).withColumn("own", own)
    k = F.count_if(F.col("d") < F.col("own")) + 0.5 * (F.count_if(F.col("d") == F.col("own")) - 1)
    return d.groupBy("query_id").agg((1 - k / (F.count(F.lit(1)) - 1)).alias("score"))


def top_sign_agreement(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Share of equal signs on the k elements with the largest |y| of each row, ties by element."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("y")), "element")
    top = pairs.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    return top.groupBy(*keys).agg(F.avg((F.signum("x") == F.signum("y")).cast("double")).alias("sign_agreement"))


def reliable_energy(halves: DataFrame, keys: list[str]) -> DataFrame:
    """Inner product of two halves a and b, centred over perturbations, per row."""
    axis = Window.partitionBy("context", "gene")
    a, b = F.col("a") - F.avg("a").over(axis), F.col("b") - F.avg("b").over(axis)
    return halves.withColumns({"ac": a, "bc": b}).groupBy(*keys).agg(F.sum(F.col("ac") * F.col("bc")).alias("energy"))


def quality(halves: DataFrame, prediction: str, floor: float) -> DataFrame:
    """Per context and perturbation: -(a - B)(b - B) over a b summed over genes, where the signal exceeds the floor."""
    a, b, p = F.col("a"), F.col("b"), F.col(prediction)
    signal = F.sum(a * b)
    return halves.groupBy("context", "perturbation").agg(ratio(-F.sum((a - p) * (b - p)), signal, floor).alias("quality"), signal.alias("signal"))
