"""Run-history, log and incremental-job queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from footreach.operators import runs as RU
from footreach.operators import split as SP
from footreach.operators.relational import with_scalar
from footreach.plans import bindings as B
from footreach.plans.registry import query, r6
from footreach.sources import readers as RD
from footreach.sources import writers as WR
from footreach.streaming import incremental as T


@query("carried_metrics", "W7", B.sql("history", """
SELECT run, epoch, round(last_value(val_kl_divergence IGNORE NULLS) OVER w, 6) AS val_kl_divergence, round(last_value(val_top1_accuracy IGNORE NULLS) OVER w, 6) AS val_top1_accuracy
FROM history WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def carried_metrics(spark, sf):
    h = B.history(spark, sf).select("run", "epoch", "val_kl_divergence", "val_top1_accuracy")
    out = RU.carry_forward(h, ["val_kl_divergence", "val_top1_accuracy"])
    return out.select("run", "epoch", r6("val_kl_divergence").alias("val_kl_divergence"), r6("val_top1_accuracy").alias("val_top1_accuracy"))


@query("early_stopping", "W6", B.sql("history", """
, o AS (SELECT run, epoch, val_loss AS v, row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 AS n FROM history),
walk(run, n, best, hit, bad) AS (SELECT run, n, v, n, CAST(0 AS bigint) FROM o WHERE n = 0
  UNION ALL SELECT o.run, o.n, CASE WHEN o.v < best - 0.5e0 THEN o.v ELSE best END, CASE WHEN o.v < best - 0.5e0 THEN o.n ELSE hit END, CASE WHEN o.v < best - 0.5e0 THEN 0 ELSE bad + 1 END
  FROM walk w JOIN o ON o.run = w.run AND o.n = w.n + 1 WHERE w.bad < 20),
ends AS (SELECT run, max(n) AS n FROM walk GROUP BY 1)
SELECT w.run, round(w.best, 6) AS best_loss, b.epoch AS best_epoch, CASE WHEN w.bad >= 20 THEN s.epoch END AS stop_epoch, (SELECT count(*) FROM o WHERE o.run = w.run) AS checks
FROM walk w JOIN ends USING (run, n) JOIN o b ON b.run = w.run AND b.n = w.hit JOIN o s ON s.run = w.run AND s.n = w.n""", recursive=True))
def early_stopping(spark, sf):
    return RU.patience(B.history(spark, sf), 20, 0.5).withColumn("best_loss", r6("best_loss"))


@query("metric_curves", "A27", B.sql("history", """
SELECT split, metric, count(*) AS points, round(sum(value), 4) AS total FROM (SELECT 'val' AS split, 'loss' AS metric, val_loss AS value FROM history
 UNION ALL SELECT 'val', 'kl_divergence', val_kl_divergence FROM history UNION ALL SELECT 'val', 'top1_accuracy', val_top1_accuracy FROM history) t WHERE value IS NOT NULL GROUP BY 1, 2"""))
def metric_curves(spark, sf):
    return RU.metric_curves(B.history(spark, sf)).groupBy("split", "metric").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 4).alias("total"))


_RUNS = """, runs AS (SELECT 'run_' || run AS name, min(val_loss) AS val_loss, max(val_top1_accuracy) AS top1_accuracy,
 CASE WHEN count(CASE WHEN event_type = 'error' THEN 1 END) > count(CASE WHEN event_type = 'click' THEN 1 END) + 4 THEN 'crashed' END AS error, min(ts) AS a, max(ts) AS z, count(*) AS epochs FROM history GROUP BY run)"""


def runs(spark, sf):
    h = B.history(spark, sf)
    return h.groupBy("run").agg(F.min("val_loss").alias("val_loss"), F.max("val_top1_accuracy").alias("top1_accuracy"), F.count(F.lit(1)).alias("epochs"),
                                F.when(F.count_if(F.col("event_type") == "error") > F.count_if(F.col("event_type") == "click") + 4, "crashed").alias("error"),
                                F.min("ts").alias("a"), F.max("ts").alias("z")).withColumn("name", F.concat(F.lit("run_"), F.col("run").cast("string"))).drop("run")


@query("loss_leaderboard", "W4", B.sql("history", _RUNS + """
SELECT name, val_loss, rank() OVER (ORDER BY val_loss) AS rank, rank() OVER (ORDER BY val_loss) = 1 AS is_best FROM runs WHERE error IS NULL"""))
def loss_leaderboard(spark, sf):
    return RU.leaderboard(runs(spark, sf), "val_loss").select("name", "val_loss", "rank", "is_best")


@query("accuracy_leaderboard", "W4", B.sql("history", _RUNS + """
SELECT name, top1_accuracy, rank() OVER (ORDER BY top1_accuracy DESC) AS rank FROM runs WHERE error IS NULL AND top1_accuracy IS NOT NULL ORDER BY 3, 1 LIMIT 5"""))
def accuracy_leaderboard(spark, sf):
    return RU.leaderboard(runs(spark, sf), "top1_accuracy", 5).select("name", "top1_accuracy", "rank")


@query("best_run", "W5", B.sql("history", _RUNS + "SELECT name, val_loss FROM runs ORDER BY val_loss, name LIMIT 1"))
def best_run(spark, sf):
    return RU.best_run(runs(spark, sf))


@query("pending_runs", "W14", B.sql("history", _RUNS + "SELECT name, CAST(coalesce(CASE WHEN epochs > 60 THEN epochs END, 999) AS bigint) AS priority FROM runs WHERE error IS NOT NULL OR epochs % 2 = 0"))
def pending_runs(spark, sf):
    r = runs(spark, sf)
    specs = r.select("name", F.when(F.col("epochs") > 60, F.col("epochs")).alias("priority"))
    done = r.filter(F.col("error").isNull() & (F.col("epochs") % 2 != 0)).select("name")
    return SP.pending_runs(specs, done).withColumn("priority", F.col("priority").cast("bigint"))


@query("run_durations", "F19", B.sql("history", _RUNS + "SELECT name, round(epoch_us(z) / 1e6 - epoch_us(a) / 1e6, 3) AS elapsed_seconds, strftime(a, '%Y-%m-%dT%H:%M:%S') AS started_at FROM runs"))
def run_durations(spark, sf):
    out = RU.run_durations(runs(spark, sf), "a", "z")
    return out.select("name", F.round("elapsed_seconds", 3).alias("elapsed_seconds"), "started_at")


@query("run_log", "K4 A23 S10", """
WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'cached' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CAST(sum(n) AS bigint) AS total, CAST(sum(CASE WHEN status = 'success' THEN n ELSE 0 END) AS bigint) AS success, CAST(sum(CASE WHEN status = 'failed' THEN n ELSE 0 END) AS bigint) AS failed,
 CAST(sum(CASE WHEN status = 'cached' THEN n ELSE 0 END) AS bigint) AS cached, CAST(0 AS bigint) AS skipped, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'F') AS total_amount,
 (SELECT count(*) FROM orders) AS summary_rows, (SELECT round(sum(o_totalprice), 2) FROM orders) AS summary_amount, CAST(0 AS bigint) AS summary_retries FROM s""")
def run_log(spark, sf):
    """An extraction log as JSON and CSV, both read back: the JSON summed up by outcome, the CSV by its counts."""
    path = B.scratch(spark, "log")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "cached").otherwise("failed")
    log = B.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("name"), status.alias("status"), F.col("o_totalprice").alias("amount"))
    WR.write_run_log(log, path, ["amount", "retries"])
    back = spark.read.schema("name string, status string, amount double").json(f"{path}/log")
    flat = RD.load_table(spark, f"{path}/summary", "csv", "name string, status string, amount double, retries bigint")
    flat = flat.agg(F.count(F.lit(1)).alias("summary_rows"), F.round(F.sum("amount"), 2).alias("summary_amount"), F.sum("retries").alias("summary_retries"))
    return with_scalar(RU.run_summary(back, amount="amount").withColumn("total_amount", F.round("total_amount", 2)), flat)


@query("upserted_epochs", "K8", B.sql("history", """
, base AS (SELECT run, epoch // 100 AS slot, arg_max(val_loss, epoch) AS val_loss FROM history WHERE event_type <> 'signup' GROUP BY 1, 2),
new AS (SELECT run, epoch // 100 AS slot, arg_max(val_loss, epoch) AS val_loss FROM history WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT run, slot, coalesce(new.val_loss, base.val_loss) AS val_loss FROM base FULL JOIN new USING (run, slot)"""))
def upserted_epochs(spark, sf):
    h = B.history(spark, sf).withColumn("slot", F.floor(F.col("epoch") / 100))
    cols = ["run", "slot", "epoch", "val_loss"]
    return RU.upsert_by_key(h.filter("event_type <> 'signup'").select(cols), h.filter("event_type = 'signup'").select(cols), ["run", "slot"], "epoch").select("run", "slot", "val_loss")


@query("log_results", "S12 P9", """
SELECT event_type || '_' || user_id % 7 AS run, arg_max(value, event_id) FILTER (event_type IN ('view', 'click') AND event_id % 3 <> 0) AS best_val_loss,
 arg_max(value, event_id) FILTER (event_type IN ('view', 'click') AND event_id % 3 = 0) AS test_kl_divergence FROM events GROUP BY 1""")
def log_results(spark, sf):
    """Log files as text, one or several a run, some lines unparsable; the last good value of each result line counts."""
    e = B.table(spark, sf, "events")
    v = F.col("value").cast("string")
    good = F.col("event_type").isin("view", "click")
    line = F.when(good & (F.col("event_id") % 3 != 0), F.concat(F.lit("INFO Best validation loss: "), v)).when(good, F.concat(F.lit("INFO Test KL divergence: "), v)).when(
        F.col("event_type") == "error", F.lit("WARN Test KL divergence: n/a")).otherwise(F.concat(F.lit("epoch "), v))
    path = B.scratch(spark, "logs")
    run = F.concat_ws("_", F.col("event_type"), (F.col("user_id") % 7).cast("string"))
    e.select(run.alias("run"), "event_id", line.alias("value")).repartition("run").sortWithinPartitions("run", "event_id").select("run", "value").write.partitionBy("run").text(path)
    return RD.scan_log(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "run=([^/]+)", 1).alias("run"), "best_val_loss", "test_kl_divergence")


@query("history_files", "S10", B.sql("history", "SELECT run % 4 AS part, count(*) AS epochs, round(sum(val_loss), 4) AS total FROM history GROUP BY 1"))
def history_files(spark, sf):
    """Histories as JSON files, read with the file they came from."""
    path = B.scratch(spark, "runs")
    B.history(spark, sf).select((F.col("run") % 4).alias("part"), "run", "epoch", "val_loss").write.partitionBy("part").json(path)
    back = RD.read_runs(spark, f"{path}/*/*.json", "run bigint, epoch bigint, val_loss double")
    named = back.withColumn("part", F.regexp_extract("path", r"part=(\d+)", 1).cast("bigint"))
    return named.groupBy("part").agg(F.count(F.lit(1)).alias("epochs"), F.round(F.sum("val_loss"), 4).alias("total"))


@query("incremental_features", "T1 J11", """
SELECT event_type, count(*) AS n, round(sum(value * 2), 4) AS total FROM events GROUP BY 1""")
def incremental_features(spark, sf):
    """Events land twice, overlapping; each run of the job builds only what it has not built before."""
    root = B.scratch(spark, "incremental")
    land, out, state = f"{root}/land", f"{root}/out", f"{root}/state"
    e = B.table(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (e.filter(F.col("ts") < middle), e):
        part.write.mode("append").parquet(land)
        src = spark.readStream.schema(e.schema).parquet(land)
        T.run_incremental(src, out, state, lambda d: d.withColumn("feature", F.col("value") * 2), ["event_id"]).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("feature"), 4).alias("total"))


@query("streamed_metrics", "T2 K8", """
SELECT user_id AS run, count(*) AS n, round(avg(value), 6) AS mean_loss, min(value) AS min_loss, max(value) AS max_loss FROM events GROUP BY 1""")
def streamed_metrics(spark, sf):
    """Running metrics per run in update mode; every batch upserts its changed rows, the latest batch wins."""
    root = B.scratch(spark, "stream")
    e = B.table(spark, sf, "events")
    src = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    m = T.stream_metrics(src.select(F.col("user_id").alias("run"), F.col("value").alias("loss")), ["run"], ["loss"])

    def put(df, batch_id):
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/b{batch_id}")
    m.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/out")
    latest = rows.groupBy("run").agg(F.max_by(F.struct("n", "mean_loss", "min_loss", "max_loss"), "batch").alias("m")).select("run", "m.*")
    return latest.withColumn("mean_loss", r6("mean_loss"))




@query("corrected_metrics", "T2 K8", """
WITH last AS (SELECT user_id AS run, event_id % 40 AS epoch, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)
SELECT run, count(*) AS n, round(sum(value), 2) AS total_loss, min(value) AS min_loss, max(value) AS max_loss FROM last GROUP BY 1""")
def corrected_metrics(spark, sf):
    """Entries of forty epochs a run land in three batches, later ones replacing earlier ones of the same epoch."""
    root = B.scratch(spark, "corrected")
    land, out = f"{root}/land", f"{root}/out"
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 40).alias("epoch"), F.col("event_id").alias("version"), F.col("value").alias("loss"))

    def put(df, batch_id):
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/b{batch_id}")
    for part in range(3):
        e.filter(F.pmod(F.floor(F.col("version") / 7), F.lit(3)) == part).write.mode("append").parquet(land)
        changed = T.stream_corrected(spark.readStream.schema(e.schema).parquet(land), ["loss"])
        changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    m = T.latest_slices(spark.read.option("recursiveFileLookup", "true").parquet(out), ["loss"])
    return m.select("run", "n", F.round("loss_sum", 2).alias("total_loss"), F.col("loss_min").alias("min_loss"), F.col("loss_max").alias("max_loss"))


@query("upserted_table", "K8", """
WITH h AS (SELECT user_id AS run, event_id // 100 AS slot, value, event_id FROM events)
SELECT run, slot, arg_max(value, event_id) AS val_loss FROM h GROUP BY 1, 2""")
def upserted_table(spark, sf):
    """A table of the latest entry of each run and slot, kept in buckets and upserted with the newer half of the events."""
    path = B.scratch(spark, "upserts") + "/table"
    e = B.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 100).alias("slot"), F.col("event_id").alias("epoch"), F.col("value").alias("val_loss"))
    newest = e.groupBy("run", "slot").agg(F.max_by("epoch", "epoch").alias("epoch"), F.max_by("val_loss", "epoch").alias("val_loss"))
    RU.upsert_table(path, e.filter("epoch % 3 <> 0"), ["run", "slot"], "epoch")
    RU.upsert_table(path, newest, ["run", "slot"], "epoch")
    return spark.read.parquet(path).select("run", "slot", "val_loss")
