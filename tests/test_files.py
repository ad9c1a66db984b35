import json
import os

import pytest
from footreach import session
from footreach.sources import readers as RD
from footreach.sources import writers as WR
from footreach.streaming import incremental as T
from pyspark.sql import functions as F


def test_geojson_collection(spark, tmp_path):
    square = [[[2.35, 48.85], [2.36, 48.85], [2.36, 48.86], [2.35, 48.86], [2.35, 48.85]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "A", "label": "Compliant", "verification_status": "verified"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"name": "B", "label": "Non-Compliant"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
        {"type": "Feature", "properties": {"name": "P"}, "geometry": {"type": "Point", "coordinates": [2.3, 48.8]}},
        {"type": "Feature", "properties": {"name": "L"}, "geometry": {"type": "LineString", "coordinates": [[2.3, 48.8], [2.4, 48.9]]}}]}
    path = tmp_path / "areas.geojson"
    path.write_text(json.dumps(doc, indent=1))
    rows = {r.name: r for r in RD.read_areas(spark, str(path)).collect()}
    assert (rows["A"].label, rows["A"].verification_status, rows["B"].verification_status) == ("Compliant", "verified", None)
    assert len(rows["A"].rings) == 1 and len(rows["B"].rings) == 2 and rows["A"].rings[0][2].x == 2.36
    assert (rows["P"].x, rows["P"].y, rows["P"].rings) == (2.3, 48.8, None) and len(rows["L"].line) == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        RD.read_geojson(spark, str(tmp_path / "none.geojson")).collect()
    broken = tmp_path / "broken.geojson"
    broken.write_text("{ not json")
    with pytest.raises(Exception):
        RD.read_geojson(spark, str(broken)).collect()


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text("""<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d9" for="edge" attr.name="length" attr.type="string"/>
<key id="d5" for="node" attr.name="x" attr.type="string"/><key id="d4" for="node" attr.name="y" attr.type="string"/>
<graph edgedefault="directed"><node id="1"><data key="d4">48.8566</data><data key="d5">2.3522</data></node><node id="2"><data key="d4">48.8576</data><data key="d5">2.3532</data></node>
<edge source="1" target="2" id="0"><data key="d9">100.0</data></edge><edge source="2" target="1" id="1"><data key="d9">bad</data></edge></graph></graphml>""")
    nodes, edges = RD.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(map(tuple, nodes.collect())) == [(1, 2.3522, 48.8566), (2, 2.3532, 48.8576)]
    assert sorted(map(tuple, edges.collect()), key=str) == [(1, 2, 0, 100.0), (2, 1, 1, None)]


def test_tables_and_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    WR.save_table(df, f"{tmp_path}/deep/er/t", "csv")
    assert RD.load_table(spark, f"{tmp_path}/deep/er/t", "csv", "x int, y string").exceptAll(df).isEmpty()
    WR.save_table(df, f"{tmp_path}/p")
    assert RD.load_table(spark, f"{tmp_path}/p").count() == 2
    for call in (lambda: WR.save_table(df, "x", "xlsx"), lambda: RD.load_table(spark, "x", "xlsx")):
        with pytest.raises(ValueError, match="xlsx"):
            call()
    with pytest.raises(Exception):
        RD.read_features(spark, f"{tmp_path}/deep")


def test_feature_tree_replaces_only_its_areas(spark, tmp_path):
    out = f"{tmp_path}/f"
    rows = spark.createDataFrame([(0, "Le Marais", "compliant", 1.0), (1, "Belleville", "compliant", 2.0)], "target_id int, neighborhood_name string, status string, v double")
    WR.write_features(rows, out)
    WR.write_features(rows.filter("target_id = 0").withColumn("v", F.lit(9.0)), out)
    back = spark.read.parquet(out)
    assert sorted((r.target_id, r.v, r.neighborhood) for r in back.collect()) == [(0, 9.0, "le_marais"), (1, 2.0, "belleville")]


def test_file_inventory(spark, tmp_path):
    (tmp_path / "a.geojson").write_text("{}")
    (tmp_path / "b.geojson").write_text("")
    got = {r.name: r.state for r in RD.file_inventory(spark, str(tmp_path), ["a.geojson", "b.geojson", "c.geojson"]).collect()}
    assert got == {"a.geojson": "found", "b.geojson": "empty", "c.geojson": "missing"}
    assert RD.first_existing(spark, [f"{tmp_path}/zz", f"{tmp_path}/a.geojson"]).endswith("a.geojson")
    with pytest.raises(FileNotFoundError):
        RD.first_existing(spark, [f"{tmp_path}/zz"])


def test_one_large_collection_is_read_in_many_tasks(spark, tmp_path):
    """Features across split borders come once, in every usual layout; odd layouts fall back or fail, none is lost."""
    import json
    rows = [{"type": "Feature", "properties": {"name": f'n{i} {{"type":"Feature"', "v": i}, "geometry": {"type": "Point", "coordinates": [i / 7, -i]}} for i in range(3000)]
    layouts = {"dense": (",", ":", None), "spaced": (", ", ": ", None), "indented": (",", ": ", 2)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name, (comma, colon, indent) in layouts.items():
            for extra in ({}, {"bbox": [0, 0, 1, 1]}):
                p = tmp_path / f"{name}{len(extra)}.geojson"
                p.write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name"}, "features": rows, **extra}, separators=(comma, colon), indent=indent))
                df = RD.read_geojson(spark, str(p))
                assert df.rdd.getNumPartitions() > 5
                got = sorted((int(r.properties["v"]), r.properties["name"], r.x, r.y) for r in df.collect())
                assert got == [(i, f'n{i} {{"type":"Feature"', i / 7, float(-i)) for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    late = tmp_path / "late.geojson"
    late.write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}, "type": "Feature"}] * 3}))
    assert RD.read_geojson(spark, str(late)).count() == 3
    mixed = tmp_path / "mixed.geojson"
    mixed.write_text('{"type":"FeatureCollection","features":[' + json.dumps(rows[0]) + "," + json.dumps(rows[1], separators=(",", ":")) + "]}")
    with pytest.raises(Exception):  # noqa: B017
        RD.read_geojson(spark, str(mixed)).collect()
    cut = tmp_path / "cut.geojson"
    cut.write_text(json.dumps({"type": "FeatureCollection", "features": rows[:5]})[:-90])
    with pytest.raises(Exception):  # noqa: B017
        RD.read_geojson(spark, str(cut)).collect()
    empty = tmp_path / "empty.geojson"
    empty.write_text('{"type": "FeatureCollection", "features": []}')
    assert RD.read_geojson(spark, str(empty)).count() == 0


def test_incremental_job_builds_each_key_once(spark, tmp_path):
    land, out, state = (f"{tmp_path}/{n}" for n in ("land", "out", "state"))
    built = []

    def run():
        src = spark.readStream.schema("target_id bigint, v double").parquet(land)
        q = T.run_incremental(src, out, state, lambda d: (built.append(d.count()), d)[1], ["target_id"])
        q.awaitTermination()

    def put(lo, hi):
        spark.range(lo, hi).select(F.col("id").alias("target_id"), F.lit(1.0).alias("v")).write.mode("append").parquet(land)

    put(0, 10)
    run()
    put(5, 20)
    run()
    run()
    assert built == [10, 10]
    assert sorted(r.target_id for r in spark.read.parquet(out).collect()) == list(range(20))
    again = T.run_incremental(spark.readStream.schema("target_id bigint, v double").parquet(land), out, f"{tmp_path}/fresh-state", lambda d: d, ["target_id"])
    again.awaitTermination()  # a lost checkpoint replays batch 0 into its own folder
    assert sorted(r.target_id for r in spark.read.parquet(out).collect()) == list(range(20))


def test_incremental_job_looks_through_its_state_once(spark, tmp_path):
    """A batch's rows are a table for those who build from them, and the tables of a batch go with it."""
    land, out, state = (f"{tmp_path}/{n}" for n in ("land", "out", "state"))
    spark.range(20).select(F.col("id").alias("k")).write.parquet(land)
    plans, folders = [], []

    def build(d):
        kept = session.cut_lineage(d.groupBy("k").count())
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        folders.extend(os.path.dirname(f.removeprefix("file:")) for f in kept.inputFiles())
        return d.join(kept, "k")

    before = session.cut_lineage(spark.range(3))
    T.run_incremental(spark.readStream.schema("k bigint").parquet(land), out, state, build, ["k"]).awaitTermination()
    assert plans and "StreamingDeduplicate" not in plans[0]
    assert folders and not any(os.path.exists(f) for f in folders)
    assert spark.read.parquet(out).count() == 20 and before.count() == session.cut_lineage(spark.range(3)).count() == 3


def test_incremental_job_reads_no_old_output(spark, tmp_path):
    """The keys done are state: old output can be taken away, and a replayed batch overwrites its own folder."""
    land, out, state = (f"{tmp_path}/{n}" for n in ("land", "out", "state"))

    def put(lo, hi):
        spark.range(lo, hi).select(F.col("id").alias("k"), F.lit(1.0).alias("v")).write.mode("append").parquet(land)
        T.run_incremental(spark.readStream.schema("k bigint, v double").parquet(land), out, state, lambda d: d, ["k"]).awaitTermination()

    put(0, 50)
    moved = spark.read.parquet(out).select("k").collect()
    for f in tmp_path.glob("out/job=*/batch=0/*.parquet"):
        f.write_bytes(b"not parquet")  # nobody may read it
    put(30, 80)
    later = spark.read.parquet(*[str(p) for p in tmp_path.glob("out/job=*/batch=1")])
    assert sorted(r.k for r in moved) == list(range(50)) and sorted(r.k for r in later.collect()) == list(range(50, 80))
    last = max(tmp_path.glob("state/commits/[0-9]*"), key=lambda p: int(p.name))
    for p in tmp_path.glob(f"state/commits/*{last.name}*"):
        p.unlink()  # the driver was lost after the write and before the commit
    put(0, 0)
    again = spark.read.parquet(*[str(p) for p in tmp_path.glob("out/job=*/batch=1")])
    assert sorted(r.k for r in again.collect()) == list(range(50, 80))


def test_entries_that_land_again_replace_the_old_ones(spark, tmp_path):
    """Three batches with corrections, late old versions and repeats equal the batch result; minima and maxima are taken back."""
    import random
    rng = random.Random(9)
    land, out, state = (f"{tmp_path}/{n}" for n in ("land", "out", "state"))
    schema = "run string, epoch bigint, version bigint, loss double, kl double"
    seen, entries = [], {}
    for batch in range(3):
        rows = [(f"r{rng.randint(0, 4)}", rng.choice([rng.randint(0, 30), 5000]), rng.randint(0, 9), rng.choice([None, rng.uniform(-5, 5)]), float(rng.randint(0, 9))) for _ in range(120)]
        rows += seen[:20]
        seen += rows
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(land)
        src = T.stream_corrected(spark.readStream.schema(schema).parquet(land), ["loss", "kl"])
        src.writeStream.outputMode("update").foreachBatch(lambda d, b: d.withColumn("batch", F.lit(b)).write.mode("overwrite").parquet(f"{out}/b={b}")).option(
            "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        for r, e, v, *x in rows:
            new = (v, *[(y is not None, y or 0.0) for y in x])
            entries[r, e] = max(entries.get((r, e), new), new)
        want = {}
        for (r, _), (_, *x) in entries.items():
            want.setdefault(r, []).append([y if some else None for some, y in x])
        got = {r.run: r for r in T.latest_slices(spark.read.parquet(out).drop("b"), ["loss", "kl"]).collect()}
        assert got.keys() == want.keys()
        for r, x in want.items():
            assert got[r].n == len(x)
            for i, m in enumerate(("loss", "kl")):
                known = [y[i] for y in x if y[i] is not None]
                assert (got[r][f"{m}_min"], got[r][f"{m}_max"]) == (min(known), max(known)) and got[r][f"{m}_sum"] == pytest.approx(sum(known))


def test_tables_of_lineage_cuts_can_be_released(spark, tmp_path):
    import glob
    folder = session._own_folder(spark)
    kept = session.cut_lineage(spark.range(7))
    assert kept.count() == 7 and glob.glob(f"{folder.removeprefix('file:')}/*/*.parquet")
    session.release_tables(spark)
    assert not glob.glob(f"{folder.removeprefix('file:')}/*")
    assert session.cut_lineage(spark.range(3)).count() == 3


def test_checkpoint_folder_comes_from_the_session(spark):
    first = session.ensure_checkpoint_dir(spark)
    assert session.ensure_checkpoint_dir(spark) == first
    df = session.cut_lineage(spark.range(5))
    assert df.count() == 5
