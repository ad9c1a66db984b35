"""Scores of predicted distributions. predictions: target_id, neighborhood_name, predicted_probs, target_probs, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.constants import N_CATEGORIES
from footreach.functions import vectors as V
from footreach.operators.quantiles import histogram

EPS_ENTROPY = 1e-12


def _classes(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("class"))


def predicted_class() -> Column:
    return V.argmax_class(V.as_double("predicted_probs"))


def target_class() -> Column:
    return V.argmax_class(V.as_double("target_probs"))


def parse_prob_arrays(df: DataFrame, cols=("predicted_probs", "target_probs")) -> DataFrame:
    """Text lists to arrays; rows whose text is no flat list of numbers are dropped."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.from_json(F.col(c), "array<double>"))
    for c in cols:
        out = out.filter(F.col(c).isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull()))
    return out


def class_weights(df: DataFrame, col: str = "target_prob_vector", cap: float = 3.0, n: int = N_CATEGORIES) -> DataFrame:
    """Per class: rows whose largest element it is, and min(cap, sqrt(total / count)); 1 for an absent class."""
    counts = df.groupBy(V.argmax_class(V.as_double(col)).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("t")).select("t")
    return _classes(df.sparkSession, n).join(counts, "class", "left").select(
        "class", F.coalesce("count", F.lit(0)).alias("count"), F.least(F.sqrt(F.coalesce(
            F.try_divide(total.scalar().cast("double"), F.col("count").cast("double")), F.lit(1.0))), F.lit(float(cap))).alias("weight"))


def class_distribution(df: DataFrame, col: str, n: int = N_CATEGORIES, by: list[str] = ()) -> DataFrame:
    """Mean of each element over all rows: class, mean. Elements are averaged side by side, rows are not exploded."""
    one = df.groupBy(*by).agg(*[F.avg(F.try_element_at(V.as_double(col), F.lit(i + 1))).alias(f"_p{i}") for i in range(n)])
    return one.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("class"), F.col(f"_p{i}").alias("mean")) for i in range(n)])).alias("e")
                      ).select(*by, "e.*")


def per_class_recall(preds: DataFrame, n: int = N_CATEGORIES) -> DataFrame:
    got = preds.select(target_class().alias("class"), (predicted_class() == target_class()).cast("double").alias("hit")).groupBy(
        "class").agg(F.count(F.lit(1)).alias("support"), F.avg("hit").alias("recall"))
    return _classes(preds.sparkSession, n).join(got, "class", "left").fillna(0, ["support"]).fillna(0.0, ["recall"])


def group_accuracy(preds: DataFrame, group: str = "neighborhood_name", top_n: int = 20) -> DataFrame:
    """Accuracy of the groups with most rows (name breaks ties)."""
    return preds.select(group, (predicted_class() == target_class()).cast("double").alias("hit")).groupBy(group).agg(
        F.count(F.lit(1)).alias("count"), F.avg("hit").alias("accuracy")).orderBy(F.desc("count"), group).limit(top_n)


def reliability(preds: DataFrame, n_bins: int = 10) -> DataFrame:
    """Bins (lo, hi] of the top probability: bin, count, accuracy, confidence; an empty bin has accuracy 0, its midpoint."""
    edges = [i / n_bins for i in range(n_bins + 1)]
    conf = F.array_max(V.as_double("predicted_probs"))
    bin_of: Column = F.lit(None).cast("int")
    for i in reversed(range(n_bins)):
        bin_of = F.when((F.col("conf") > edges[i]) & (F.col("conf") <= edges[i + 1]), F.lit(i)).otherwise(bin_of)
    got = preds.select(conf.alias("conf"), (predicted_class() == target_class()).cast("double").alias("hit")).withColumn(
        "bin", bin_of).filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("hit").alias("accuracy"), F.avg("conf").alias("confidence"))
    return preds.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select(
        "bin", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce("confidence", (F.col("bin") + 0.5) / n_bins).alias("confidence"))


def ece(preds: DataFrame, n_bins: int = 10) -> DataFrame:
    """Expected calibration error over all rows (rows with confidence 0 count in the denominator)."""
    total = preds.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).select("n")
    return reliability(preds, n_bins).withColumn("_n", total.scalar()).agg(
        F.sum(F.col("count") / F.col("_n") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("ece"))


def with_entropy(preds: DataFrame) -> DataFrame:
    return preds.withColumn("pred_entropy", V.entropy("predicted_probs", EPS_ENTROPY)).withColumn(
        "target_entropy", V.entropy("target_probs", EPS_ENTROPY))


def entropy_summary(preds: DataFrame) -> DataFrame:
    return with_entropy(preds).agg(F.count(F.lit(1)).alias("n"), F.avg("pred_entropy").alias("mean_pred_entropy"),
                                   F.avg("target_entropy").alias("mean_target_entropy"))


def entropy_histogram(preds: DataFrame, which: str = "pred_entropy", bins: int = 30) -> DataFrame:
    return histogram(with_entropy(preds), which, bins)


def evaluate(preds: DataFrame, loss: str | None = "loss", ks=(1, 3)) -> DataFrame:
    """One row: mean loss, mean KL (eps in both logarithms), top-k accuracy for each k, rows."""
    aggs = [F.avg(V.kl("target_probs", "predicted_probs")).alias("kl_divergence")]
    if loss:
        aggs.append(F.avg(loss).alias("loss"))
    for k in ks:
        aggs.append(F.avg(V.top_k_hit("predicted_probs", "target_probs", k).cast("double")).alias(f"top{k}_accuracy"))
    return preds.agg(*aggs, F.count(F.lit(1)).alias("num_samples"))


def sample_stats(preds: DataFrame, cols=("loss", "kl_divergence")) -> DataFrame:
    aggs = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return preds.agg(*aggs, F.avg((predicted_class() == target_class()).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("num_samples"))


def prediction_layer(preds: DataFrame, points: DataFrame, key: str = "target_id") -> DataFrame:
    """Points with the class predicted for them (a ready class is kept, else the largest element)."""
    cls = F.coalesce("predicted_class", predicted_class()) if "predicted_class" in preds.columns else predicted_class()
    return points.join(preds.select(key, cls.alias("class")), key)


def reduce_loss(df: DataFrame, terms: str, mode: str) -> DataFrame:
    """Reduce per-category loss terms: none (per row), batchmean, mean (over rows and categories), sum."""
    per_row = V.vsum(terms)
    if mode == "none":
        return df.withColumn("loss", per_row)
    if mode == "batchmean":
        return df.agg(F.avg(per_row).alias("loss"))
    if mode == "mean":
        return df.agg((F.sum(per_row) / F.sum(F.size(terms))).alias("loss"))
    if mode == "sum":
        return df.agg(F.sum(per_row).alias("loss"))
    raise ValueError(f"unknown reduction mode: {mode}")


def distance_alignment(preds: DataFrame, distances: str = "distances", tau: float = 200.0) -> DataFrame:
    return preds.agg(F.avg(V.distance_alignment("predicted_probs", distances, tau)).alias("distance_alignment"))
