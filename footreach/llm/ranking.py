"""Ranked lexical search of documents for items by dense matrix products, exact in integers and in ties.

Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. With N documents that have a
term, L terms in all, n terms in a document, df documents with a term and tf its occurrences in one:
w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + 50 n N div L, score = sum of w * (10^9 tf div (1000 tf + 20 m)) over an item's terms, once each.

1. *Blocks.* Items are dealt to blocks by the running sum of their distinct terms, at most 2 * `BLOCK_TERMS` terms each; an
   item of more terms is cut into parts, blocks of their own. What a task holds of the items is one block.
2. *Impacts.* One pass over the documents writes, per document, its n and its (term number, tf) pairs of the block's compact
   vocabulary; df, N and L are counted from that table over all documents.
3. *Tiles.* A tile of `ROWS` documents becomes a dense float64 matrix over the terms that occur in it, a tile of `ITEMS`
   items one of their weights; BLAS multiplies them in slices of so many terms that a partial sum stays below 2^53, so every
   product is an exact integer, and slices are added as 64-bit integers.
4. *Top k.* A task keeps each item's best `k` by (score descending, doc_id ascending): a later document joins only with a
   score of at least the k-th, so ties are never lost. Tasks' lists meet in groups of `FAN_IN` tasks, then in one list per item.
   Of an item in parts the tasks give every positive partial score, which are summed per document before the ranking.

Defined cases: a null text has no terms; a null doc_id ranks like any other, last among equal scores; repeated rows are
documents each. Rows that share an item_id (null included) are one item with the terms of all; an item without terms or hits
has no rows. Empty tables give an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footreach.llm.batches import ALNUM, lower_bytes, small_batches
from footreach.session import cut_lineage

TOP, BLOCK_TERMS, ROWS, ITEMS, COLUMNS, FAN_IN = 50, 100_000, 256, 256, 8192, 256
PIECE = 1 << 20
IMPACT_MAX = 1_000_000  # 10^9 tf div (1000 tf + 20 m) is below it
_BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
_LAST = np.iinfo(np.int64).max


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end between terms."""
    at = 0
    while len(text) - at > PIECE:
        cut = _BREAK.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def term_key(term: bytes) -> bytes:
    """The term, or a digest in place of a very long one, so that a vocabulary's size is bounded by its number of terms."""
    return term if len(term) <= 64 else b"\x00" + xxhash.xxh3_128_digest(term)


def term_counts(text: str | None) -> Counter:
    counts = Counter()
    for piece in pieces(lower_bytes(text)):
        counts.update(ALNUM.findall(piece))
    for term in [t for t in counts if len(t) > 64]:
        counts[term_key(term)] += counts.pop(term)
    return counts


# ---- items ---------------------------------------------------------------------------------------

def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in small_batches(batches):
        for i, text in enumerate(texts):
            terms = sorted(term_counts(text))
            if terms:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i].as_py()] * len(terms), pa.string()), pa.array(terms, pa.binary())], names=["item", "term"])


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item (text key), term, block, whole: the items' distinct terms dealt to blocks; `whole` is false for parts of an item."""
    keyed = items.selectExpr(f"CASE WHEN `{id_col}` IS NULL THEN 'null' ELSE concat('=', `{id_col}`) END AS item", f"cast(`{text_col}` AS string) AS text")
    terms = cut_lineage(keyed.mapInArrow(_item_terms, "item string, term binary").distinct())
    sizes = cut_lineage(terms.groupBy("item").agg(F.count(F.lit(1)).alias("size")).repartitionByRange("item").withColumn("slice", F.spark_partition_id()))
    short = sizes.filter(F.col("size") <= block_terms)
    before = short.groupBy("slice").agg(F.sum("size").alias("total")).withColumn(
        "before", F.coalesce(F.sum("total").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a slice
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("slice").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = short.join(before, "slice").select("item", F.floor((F.col("before") + inside) / block_terms).alias("block"), F.lit(True).alias("whole"))
    parts = terms.join(sizes.filter(F.col("size") > block_terms).select("item", "size"), "item").select(
        "item", "term", F.concat_ws("/", "item", F.pmod(F.xxhash64("term"), F.ceil(2 * F.col("size") / block_terms)).cast("string")).alias("name"))
    numbered = parts.select("name").distinct().withColumn("block", -F.dense_rank().over(Window.orderBy("name")))  # one name per part of a very long item
    cut = parts.join(numbered, "name").select("item", "term", "block", F.lit(False).alias("whole"))
    return terms.join(dealt, "item").select("item", "term", F.col("block").cast("bigint").alias("block"), "whole").unionByName(cut)


class Block:
    """One block on the driver and in tasks: vocabulary, items and, once df is known, weights."""

    def __init__(self, rows: list):
        self.names = sorted({r.item for r in rows})
        self.whole = rows[0].whole
        terms = sorted({bytes(r.term) for r in rows})
        self.vocabulary = {t: i for i, t in enumerate(terms)}
        at = {n: i for i, n in enumerate(self.names)}
        self.item = np.array([at[r.item] for r in rows], np.int32)
        self.term = np.array([self.vocabulary[bytes(r.term)] for r in rows], np.int32)
        order = np.argsort(self.item, kind="stable")
        self.item, self.term = self.item[order], self.term[order]
        self.weight: np.ndarray | None = None

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.vocabulary))], np.int64)


# ---- documents -----------------------------------------------------------------------------------

_IMPACTS = "doc_id bigint, digest binary, n bigint, terms array<int>, tfs array<bigint>"


def impacts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the text, n, and the vocabulary's terms in it with their counts, for documents with a term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for ids, texts in small_batches(batches):
            kept, digests, sizes, terms, tfs = [], [], [], [], []
            for i, text in enumerate(texts):
                counts = term_counts(text)
                if counts:
                    kept.append(i)
                    digests.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                    sizes.append(counts.total())
                    found = sorted((vocabulary[t], counts[t]) for t in counts.keys() & known)
                    terms.append([f[0] for f in found])
                    tfs.append([f[1] for f in found])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "terms", "tfs"])

    return docs.selectExpr(f"cast(`{id_col}` AS bigint) AS doc_id", f"cast(`{text_col}` AS string) AS text").mapInArrow(count, _IMPACTS)


def _document_frequencies(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
            docs += b.num_rows
            total += sum(b.column("n").to_pylist())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((seen, [-1, -2])).astype(np.int32)), pa.array(np.concatenate((df[seen], [docs, total])))], names=["term", "n"])
    return count


class _Best:
    """An item's best k so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.none = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        s, i, x = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids)), np.concatenate((self.none, none))
        order = np.lexsort((i, x, -s))[:self.k]
        self.scores, self.ids, self.none = s[order], i[order], x[order]


def document_tile(terms: np.ndarray, values: np.ndarray, row: np.ndarray, rows: int, columns: np.ndarray) -> np.ndarray:
    """Dense (documents x columns) float64 matrix of the impacts of the terms `columns` (sorted)."""
    tile = np.zeros((rows, len(columns)))
    at = np.searchsorted(columns, terms)
    tile[row, at] = values
    return tile


def tile_scores(terms: np.ndarray, values: np.ndarray, row: np.ndarray, rows: int, block: Block, first: int, last: int) -> np.ndarray:
    """Exact int64 scores (items first..last-1 x documents) from products over slices of the terms that both sides have."""
    a, b = np.searchsorted(block.item, (first, last))
    item, own = block.item[a:b] - first, block.term[a:b]
    both = np.intersect1d(terms, own)
    out = np.zeros((last - first, rows), np.int64)
    top = max(1, int(block.weight.max(initial=1)))
    width = max(1, min(COLUMNS, (2**53 - 1) // (top * IMPACT_MAX)))
    for at in range(0, len(both), width):
        columns = both[at:at + width]
        here, there = np.isin(terms, columns), np.isin(own, columns)
        left = np.zeros((last - first, len(columns)))
        left[item[there], np.searchsorted(columns, own[there])] = block.weight[own[there]]
        right = document_tile(terms[here], values[here], row[here], rows, columns)
        out += (left @ right.T).astype(np.int64)
    return out


_FOUND = "item int, doc_id bigint, digest binary, score bigint, task int"


def _score(block: Block, n_docs: int, total: int, k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, best = TaskContext.get().partitionId(), [_Best(k) for _ in block.names] if block.whole else []

        def rows(item, ids, none, digests, scores):
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, mask=none), pa.array(digests, pa.binary()), pa.array(scores, pa.int64()),
                                               pa.array(np.full(len(scores), task, np.int32))], names=["item", "doc_id", "digest", "score", "task"])

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids = part.column("doc_id")
                none = np.asarray(ids.is_null())
                ids = ids.fill_null(_LAST).to_numpy()
                lists = part.column("terms")
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                terms, tf = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("terms", "tfs"))
                m = np.array([50 + 50 * n * n_docs // total for n in part.column("n").to_pylist()], np.int64)
                values = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
                for first in range(0, len(block.names), ITEMS):
                    last = min(first + ITEMS, len(block.names))
                    scores = tile_scores(terms, values, row, part.num_rows, block, first, last)
                    if not block.whole:
                        i, d = np.nonzero(scores > 0)
                        digests = part.column("digest").take(pa.array(d))
                        yield rows(i + first, ids[d], none[d], digests, scores[i, d])
                        continue
                    least = np.array([best[i].least for i in range(first, last)])[:, None]
                    may = scores >= least
                    for i in np.flatnonzero(may.any(axis=1)):
                        d = np.flatnonzero(may[i])
                        best[first + i].add(scores[i, d], ids[d], none[d])
        for i, x in enumerate(best):
            if len(x.scores):
                yield rows(np.full(len(x.scores), i, np.int32), x.ids, x.none, [None] * len(x.scores), x.scores)
    return score


# ---- search --------------------------------------------------------------------------------------

def _top(rows: DataFrame, k: int, *part: str) -> DataFrame:
    order = Window.partitionBy(*part).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's `k` best documents with a positive score, ties by ascending doc_id."""
    spark = docs.sparkSession
    dealt = cut_lineage(blocks(items, block_terms=block_terms))
    lists, sums = [], []
    for (number,) in sorted(map(tuple, dealt.select("block").distinct().collect())):
        block = Block(dealt.filter(F.col("block") == number).collect())
        found = cut_lineage(impacts(docs, block.vocabulary))
        counts = {r.term: r.n for r in found.select("n", "terms").mapInArrow(_document_frequencies(len(block.vocabulary)), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_docs, total = counts.get(-1, 0), counts.get(-2, 0)
        if not n_docs:
            continue
        block.weigh(n_docs, counts)
        block.vocabulary = {}  # the tasks that score need numbers only
        names = spark.createDataFrame(list(enumerate(block.names)), "item int, name string")
        scored = found.mapInArrow(_score(block, n_docs, total, k), _FOUND).join(F.broadcast(names), "item")  # at most BLOCK_TERMS names
        (lists if block.whole else sums).append(cut_lineage(scored.select("name", "doc_id", "digest", "score", "task", F.lit(number).alias("block"))))
    rows = None
    for x in lists:
        rows = x if rows is None else rows.unionByName(x)
    if sums:
        parts = sums[0]
        for x in sums[1:]:
            parts = parts.unionByName(x)
        doc = ["name", "doc_id", "digest"]
        one = parts.groupBy(*doc, "block").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("copies"))  # equal rows have equal partial scores
        whole = one.groupBy(*doc).agg(F.sum("score").alias("score"), F.max("copies").alias("copies"))
        each = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int")))).withColumn("task", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(64 * FAN_IN)).cast("int"))
        each = each.select("name", "doc_id", "digest", "score", "task", F.lit(0).cast("bigint").alias("block"))
        rows = each if rows is None else rows.unionByName(each)
    ids = items.select("item_id").distinct().withColumn("name", F.expr("CASE WHEN item_id IS NULL THEN 'null' ELSE concat('=', item_id) END"))
    if rows is None:
        return ids.select("item_id", F.lit(None).cast("int").alias("rank"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("score")).filter("false")
    near = _top(rows.withColumn("group", F.floor(F.col("task") / FAN_IN)), k, "name", "group").drop("rank")
    return ids.join(_top(near, k, "name"), "name").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents), q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS w FROM benchmark),
one AS (SELECT r, unnest(ws) AS w FROM d), tf AS (SELECT r, w, count(*) AS tf FROM one WHERE w IN (SELECT w FROM q) GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
total AS (SELECT count(*)::bigint AS n_docs, sum(len(ws))::bigint AS l FROM d WHERE len(ws) > 0),
weight AS (SELECT w, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint AS weight FROM df, total),
m AS (SELECT r, doc_id, 50 + (50 * len(ws) * n_docs) // l AS m FROM d, total WHERE len(ws) > 0),
scored AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint AS score FROM tf JOIN q USING (w) JOIN weight USING (w) JOIN m USING (r) GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::int AS rank, doc_id, score FROM placed WHERE rank <= 50"""
