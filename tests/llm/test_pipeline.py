"""The corpus pipeline: each stage against plain Python on that stage's own input, and the package's place in the library."""

import os
import subprocess
import sys

import duckdb
from brute import contamination, near_duplicates, secrets as secrets_of
from edges import ROWS, SF
from test_rows import check_packing, words

import __spark_entry__ as entry
import corpus_pipeline as cp
from footreach.llm import toxicity

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = pairs(docs)
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out(toxicity.F.col("doc_id")))
    bad = {r.doc_id for r in toxicity.scores(docs, toxicity.fit(docs, labels), ["doc_id"]).collect() if r.score >= 0.5}
    step = cp.drop_toxic(spark, docs, SF)
    assert step.columns == names and pairs(step) == [p for p in before if p[0] not in bad]

    before, step = pairs(step), cp.drop_near_duplicates(spark, step, SF)
    group = near_duplicates(before)
    assert step.columns == names and pairs(step) == [p for p in before if group[p[0]][1] == p[0]]

    before, step = pairs(step), cp.drop_contaminated(spark, step, SF)
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    hit = {r[0] for r in contamination(before, items) if r[5]}
    assert step.columns == names and hit and pairs(step) == [p for p in before if p[0] not in hit]

    before, step = dict(pairs(step)), cp.redact(spark, step, SF)
    after = {r.doc_id: r for r in step.collect()}
    assert step.columns == names and after.keys() == before.keys()
    for d, t in before.items():
        has = sum(secrets_of(t)[0])
        assert (after[d].text == t) == (not has) and (not has or "<secret>" in after[d].text) and after[d].n_chars == len(after[d].text)

    out = cp.pack(spark, step, SF).collect()
    check_packing(out, [(d, words(r.text), r.source, r.text.lower()) for d, r in after.items()])
    assert sorted(map(tuple, cp.run(spark, SF).select("doc_id", "piece", "piece_length").collect())) == sorted((r.doc_id, r.piece, r.piece_length) for r in out)


def test_near_duplicates_under_repeated_and_null_ids(spark):
    """Different texts under one id all stay, equal and near ones do not, whatever their ids; which row stays is fixed."""
    long = [f"w{i}" for i in range(60)]
    near = long[:30] + ["x"] + long[31:]
    texts = {"a": " ".join(long), "b": " ".join(near), "c": "quite another text with other words in it", "d": "and a third one that nobody else has"}
    rows = [(5, texts["a"], 1), (5, texts["c"], 2), (5, texts["c"], 3), (5, texts["d"], 2), (1, texts["b"], 1), (None, texts["c"], 4), (None, texts["a"], 5), (None, "", 1), (9, "", 1)]
    got = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(parts)
        out = cp.drop_near_duplicates(spark, df, SF)
        assert out.columns == df.columns
        got.append(sorted(map(tuple, out.collect()), key=str))
    assert got[0] == got[1]
    assert [r[1] for r in got[0]].count("") == 2 and (1, texts["b"], 1) in got[0] and sum(r[1] == texts["c"] for r in got[0]) == 1 and (5, texts["d"], 2) in got[0] and len(got[0]) == 5


def test_stages_take_edge_rows(spark, edge_docs):
    step = edge_docs
    for _, stage in cp.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == edge_docs.columns
    left = {r.doc_id for r in step.select("doc_id").collect()}
    assert {2, 3, 4, 8, 12, None} <= left and 5 not in left and 9 not in left and left <= {r[0] for r in ROWS}
    assert cp.pack(spark, step, SF).count() >= len(left)
    for _, stage in cp.STAGES:
        assert stage(spark, edge_docs.limit(0), SF).count() == 0


def test_each_operator_has_a_query():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontam", "secrets", "packing"]


def test_library_does_not_need_the_package():
    code = ("import sys; sys.modules['footreach.llm'] = None; import __spark_entry__ as e; "
            "q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') and '_' in k and k[2].isdigit() for k in q) and 'pipeline' not in q")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for folder, _, files in os.walk(os.path.join(ROOT, "footreach")):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for f in files:
                if f.endswith(".py"):
                    assert "footreach.llm" not in open(os.path.join(folder, f)).read()
