"""Run histories: upserts, leaderboards, patience, carry-forward, curves, logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.functions import scalars as S
from footreach.operators.quantiles import ranks
from footreach.operators.skew import number_rows, running_last, running_min
from footreach.session import cut_lineage

SLICE = 65_536


def upsert_by_key(base: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows of `new` replace rows of `base` with the same keys, others are added; the latest version wins within `new`.

    One aggregate with map-side combine, so a key with very many versions is no hot group.
    """
    v = F.col(version) if version else F.lit(0)
    both = base.withColumn("_v", F.struct(F.lit(0).alias("side"), v.alias("v"))).unionByName(
        new.withColumn("_v", F.struct(F.lit(1).alias("side"), v.alias("v"))))
    rest = [c for c in base.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*keys, "_r.*").select(*base.columns)


def upsert_table(path: str, new: DataFrame, keys: list[str], version: str | None = None, buckets: int = 64) -> None:
    """`upsert_by_key` into a table kept as Parquet in hash buckets of the keys: only buckets that new rows fall into are read and written.

    A bucket's folder is replaced as a whole; running the same upsert again changes nothing.
    """
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    fresh = cut_lineage(new.withColumn("_bucket", bucket))
    touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # at most `buckets` numbers
    if not touched:
        return
    rows = fresh.drop("_bucket")
    try:
        old = spark.read.parquet(path).filter(F.col("_bucket").isin(touched)).select(*rows.columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        old = rows.limit(0)
    merged = cut_lineage(upsert_by_key(old, rows, keys, version).withColumn("_bucket", bucket))
    merged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def lower_is_better(metric: str) -> bool:
    return "loss" in metric.lower() or "kl" in metric.lower()


def leaderboard(runs: DataFrame, metric: str, n: int | None = None, name: str = "name", error: str | None = "error") -> DataFrame:
    """Successful runs ranked by a metric: low first for losses and divergences, high first otherwise; best one marked."""
    ok = runs.filter(F.col(error).isNull()) if error and error in runs.columns else runs
    up = lower_is_better(metric)
    ok = ok.filter(F.col(metric).isNotNull())
    ranked = ranks(ok, metric, ascending=up).drop("rank_avg").withColumnRenamed("rank_min", "rank").withColumn(
        "is_best", F.col("rank") == 1)
    out = ranked.orderBy("rank", name)
    return out.limit(n) if n else out


def best_run(runs: DataFrame, metric: str = "val_loss", name: str = "name") -> DataFrame:
    """Run with the least metric, the first name on ties: a two-column aggregate."""
    ok = runs.filter(F.col(metric).isNotNull())
    return ok.agg(F.min(F.struct(metric, name)).alias("_b")).select(
        F.col(f"_b.{name}").alias(name), F.col(f"_b.{metric}").alias(metric))


def _slice(order: str) -> Column:
    return F.floor(F.col(order) / SLICE)


def patience(history: DataFrame, patience: int, min_delta: float = 0.0, *, run: str = "run", epoch: str = "epoch",
             loss: str = "val_loss") -> DataFrame:
    """Early stopping per run: best_loss, best_epoch, stop_epoch (null when it never stops), checks.

    A check improves only if loss < best - min_delta, and best moves only then. Such a check is always below every
    earlier loss, so a distributed running minimum first throws away all others; what is left is folded in order with
    two numbers of state per run, as the sorted rows stream by (nothing is collected per run).
    """
    checks = number_rows(history.filter(F.col(loss).isNotNull() & ~F.isnan(loss)).select(run, epoch, loss),
                         [run], [F.col(epoch)], _slice(epoch), "_no")
    records = running_min(checks, [run], [F.col("_no")], _slice("_no"), loss, "_m").filter(
        F.col("_m").isNull() | (F.col(loss) < F.col("_m"))).select(F.col(run).alias("run"), F.col("_no"), F.col(loss).cast("double").alias("loss"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, best, at, stop = None, 0.0, 0, None

        def row():
            return {"run": current, "best": best, "at": at, "stop": stop}

        for pdf in batches:
            out = []
            for r, no, value in zip(pdf["run"], pdf["_no"], pdf["loss"]):
                if r != current:
                    if current is not None:
                        out.append(row())
                    current, best, at, stop = r, value, no, None
                elif stop is None:
                    if no - 1 - at >= patience:
                        stop = at + patience
                    elif value < best - min_delta:
                        best, at = value, no
            if out:
                yield pd.DataFrame(out).astype({"stop": "Int64"})
        if current is not None:
            yield pd.DataFrame([row()]).astype({"stop": "Int64"})

    run_type = history.schema[run].dataType.simpleString()
    folded = records.repartition("run").sortWithinPartitions("run", "_no").mapInPandas(
        fold, f"run {run_type}, best double, at bigint, stop bigint")
    sizes = checks.groupBy(run).agg(F.count(F.lit(1)).alias("checks"))
    ended = folded.withColumnRenamed("run", run).join(sizes, run).withColumn("stop", F.coalesce("stop", F.when(
        F.col("checks") - 1 - F.col("at") >= patience, F.col("at") + patience)))
    where = checks.select(F.col(run).alias("_r"), "_no", F.col(epoch).alias("_e"))
    marks = ended.select(F.col(run).alias("_r"), F.explode(F.array_compact(F.array("at", "stop"))).alias("_no")).distinct()
    spots = where.join(marks, ["_r", "_no"])
    at = spots.select(F.col("_r").alias(run), F.col("_no").alias("at"), F.col("_e").alias("best_epoch"))
    st = spots.select(F.col("_r").alias(run), F.col("_no").alias("stop"), F.col("_e").alias("stop_epoch"))
    return ended.join(at, [run, "at"]).join(st, [run, "stop"], "left").select(
        run, F.col("best").alias("best_loss"), "best_epoch", "stop_epoch", "checks")


def carry_forward(history: DataFrame, cols: list[str], *, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Fill skipped epochs with the last value seen in the run."""
    return running_last(history, [run], [F.col(epoch)], _slice(epoch), cols)


def metric_curves(history: DataFrame, keys=("run", "epoch"), splits=("train", "val", "test"),
                  metrics=("loss", "kl_divergence", "top1_accuracy", "top3_accuracy")) -> DataFrame:
    """Long series (keys, split, metric, value) of the columns that exist; nulls dropped."""
    have = [(s, m) for s in splits for m in metrics if f"{s}_{m}" in history.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.lit(m).alias("metric"),
                                        F.col(f"{s}_{m}").cast("double").alias("value")) for s, m in have]))
    return history.select(*keys, rows.alias("_s")).select(*keys, "_s.*").filter(F.col("value").isNotNull())


# --- fixed values: lines of a run log that carry a result ---
LOG_METRICS = {"best_val_loss": "Best validation loss:", "test_kl_divergence": "Test KL divergence:"}


def parse_log(lines: DataFrame, by: list[str] = ("path",), order: str | None = None) -> DataFrame:
    """Last parsable value of each result line, per log; unparsable text is ignored. lines: by..., value."""
    text = F.col("value")
    aggs = []
    for name, mark in LOG_METRICS.items():
        number = F.when(F.contains(text, F.lit(mark)), F.trim(F.element_at(F.split(text, ":"), -1)).try_cast("double"))
        aggs.append((F.max_by(number, F.when(number.isNotNull(), F.col(order))) if order else F.max(number)).alias(name))
    return lines.groupBy(*by).agg(*aggs)


def run_summary(log: DataFrame, by: list[str] = (), status: str = "status", amount: str | None = None) -> DataFrame:
    """Numbers of runs by outcome, and the total of an amount over the successful ones."""
    aggs = [F.count(F.lit(1)).alias("total")] + [
        F.count_if(F.col(status) == s).alias(s) for s in ("success", "failed", "cached", "skipped")]
    if amount:
        aggs.append(F.coalesce(F.sum(F.when(F.col(status) == "success", F.col(amount))), F.lit(0)).alias(f"total_{amount}"))
    return log.groupBy(*by).agg(*aggs)


def run_durations(runs: DataFrame, start: str, end: str) -> DataFrame:
    return runs.withColumn("elapsed_seconds", S.elapsed_s(start, end)).withColumn("started_at", S.iso_stamp(start))
