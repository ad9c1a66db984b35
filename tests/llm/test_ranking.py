"""Ranked search: whole tables and edge cases against plain Python, products against sums, ties over many tasks."""

import math
import random
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from brute import ALNUM, LOWER
from edges import ROWS, SF

from footreach.llm import ranking


def terms_of(text):
    return ALNUM.findall((text or "").translate(LOWER))


def search(docs, items, k=50):
    """[(item, rank, doc, score)] by plain sums over rows (doc_id, text) and (item_id, text)."""
    bags = [(d, Counter(w), len(w)) for d, w in ((d, terms_of(t)) for d, t in docs) if w]
    n, total = len(bags), sum(x for *_, x in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, words in asked.items():
        weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) for w in words} if n else {}
        scored = []
        for d, bag, size in bags:
            m = 50 + 50 * size * n // total
            s = sum(weight[w] * (1_000_000_000 * bag[w] // (1000 * bag[w] + 20 * m)) for w in words if w in bag)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def edge_tables(spark):
    docs = [r[:2] for r in ROWS] + [(d, "alpha beta words") for d in range(100, 190)]  # more equal scores than places
    items = [(1, "alpha BETA gamma"), (1, "license and word7"), (2, None), (3, ""), (4, "nowhere at all zzzz"), (None, "password the license"), (None, "one TWO"), (5, "x" * 5000), (6, " ".join(f"word{i}" for i in range(600)))]
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS score", "'z' AS name").repartition(6), \
        spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "2 AS doc_id", "3 AS block")


@pytest.mark.parametrize("block_terms", [100_000, 40])
def test_edges_and_ties_equal_plain_sums(spark, block_terms):
    """With blocks of 40 terms there are several blocks, and item 6 is cut into parts that are summed again."""
    docs, items, docs_df, items_df = edge_tables(spark)
    assert found(ranking.ranked(docs_df, items_df, block_terms=block_terms)) == search(docs, items)


def test_the_sql_says_the_same(spark):
    docs, items, docs_df, items_df = edge_tables(spark)
    con = duckdb.connect()
    con.register("documents", docs_df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", items_df.select("item_id", "text").toPandas().astype({"item_id": "Int64"}))
    got = sorted(con.sql(ranking.OP12_SQL).fetchall(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == search(docs, items)


def test_whole_table(spark):
    docs, items = (duckdb.sql(f"select {c}, text from '{SF}/{t}.parquet'").fetchall() for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert found(ranking.op12(spark, SF)) == search(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ranking.ranked(docs, items).count() == 0
    assert ranking.ranked(docs.unionByName(spark.createDataFrame([(1, "a b")], docs.schema)), items.limit(0)).count() == 0


def test_products_are_exact_beyond_the_slices(monkeypatch):
    """Weights near the largest there can be, few columns a slice: sums of many slices are exact 64-bit integers."""
    monkeypatch.setattr(ranking, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    block = ranking.Block([SimpleNamespace(item=f"i{i}", term=f"t{t}".encode(), whole=True) for i in range(5) for t in range(300) if rng.random() < 0.7])
    block.weight = rng.integers(20_000, 30_000, len(block.vocabulary))
    row, terms = np.nonzero(rng.random((9, len(block.vocabulary))) < 0.5)
    values = rng.integers(900_000, 1_000_000, len(row))
    got = ranking.tile_scores(terms.astype(np.int32), values, row, 9, block, 1, 4)
    for i in range(1, 4):
        own = set(block.term[block.item == i].tolist())
        for d in range(9):
            assert got[i - 1, d] == sum(int(block.weight[t]) * int(v) for t, v, r in zip(terms, values, row) if r == d and t in own)


def test_long_texts_are_cut_between_terms(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab é,. Z\n") for _ in range(5000)) + " " + "y" * 400
    whole = ranking.term_counts(text)
    monkeypatch.setattr(ranking, "PIECE", 50)
    assert ranking.term_counts(text) == whole
    assert whole.total() == len(terms_of(text)) and max(map(len, whole)) <= 64
