"""Benchmark decontamination with a distributed positional inverted index of the training tokens.

Words are runs of ASCII letters, digits and anything beyond ASCII, A-Z lower-cased. A window is 13 consecutive words of
an item; a shorter item, if not empty, is one window. A document word inside an occurrence of a window is hit.

1. Test items are dealt to blocks by the running sum of their words, at most 2 * `BLOCK_WORDS` words each; an item of more
   words is cut into passages that overlap by a window less one word, so no window is lost. What tasks hold of the
   benchmark is one block, whatever its size and its items' sizes. Most benchmarks are one block.
2. Corpus counts of the block's terms, over all documents, summed per task before the shuffle.
3. Every window names its two rarest terms; their places in the item are the item's anchors.
4. The lists of the anchor terms are stored as a table of (term, document, positions), dealt and sorted by term and document:
   the inverted index. A list of a very frequent term spans several files. Other terms can't be asked for by this block and
   are not stored.
5. Each posting minus its anchor's place is the start of an alignment; lists are intersected by counting, per
   (document, item, start), the anchors that agree. Two agreeing anchors make a candidate (one for one-word items).
6. An exact check of candidates against the documents' words gives the hits. Proximity matches are the items of which
   most anchors lie in a document in order within `SLOP` words of their places, whether or not a window is exact.

Defined cases: null texts have no words; a null item id is an item like any other, only its id is not among `items`
(`n_items` counts it); rows that share an item id, null included, are one item with several passages; a cut item is near
where one of its passages is; documents are told apart by (id, hash of text), so repeated rows each get their result; other columns are
ignored; an empty benchmark or table gives zero hits or no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footreach.llm.batches import ALNUM, lower_bytes, small_batches
from footreach.session import cut_lineage

WINDOW, ANCHORS, BLOCK_WORDS, SLOP, NEAR_SHARE = 13, 2, 1_000_000, 16, 0.75


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int | None = None) -> DataFrame:
    """(item, words, block): passages of items; a passage has at most `block_words` words and a block less than twice as many.

    An item is named `=id`, one without an id by the empty text.
    """
    limit = max(block_words or BLOCK_WORDS, WINDOW)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in small_batches(batches, 64):
            for i, t in enumerate(texts):
                words = [w.decode("utf-8", "surrogatepass") for w in ALNUM.findall(lower_bytes(t))]
                for at in range(0, max(1, len(words) - WINDOW + 1), limit - WINDOW + 1):
                    part = words[at:at + limit]
                    yield pa.RecordBatch.from_arrays([ids.slice(i, 1), pa.array([part], pa.list_(pa.string())), pa.array([len(part)], pa.int64())], names=["item", "words", "n"])
    items = cut_lineage(benchmark.selectExpr(f"coalesce(concat('=', cast(`{id_col}` as string)), '') as item", f"cast(`{text_col}` as string) as text")
                        .mapInArrow(tokens, "item string, words array<string>, n bigint").filter("n > 0").distinct()
                        .withColumn("place", F.xxhash64("item", "words")).repartitionByRange("place").withColumn("slice", F.spark_partition_id()))
    before = items.groupBy("slice").agg(F.sum("n").alias("all")).withColumn(
        "before", F.coalesce(F.sum("all").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a slice
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("slice").orderBy("place", "item", "words").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.join(before, "slice").select("item", "words", F.floor((F.col("before") + inside) / limit).alias("block"))


def anchors_of(words: list[bytes], counts: dict[bytes, int]) -> set[int]:
    """Places of the rarest terms of every window."""
    n, w = len(words), min(WINDOW, len(words))
    rank = sorted(range(n), key=lambda p: (counts.get(words[p], 0), words[p], p))
    out: set[int] = set()
    left = {s: ANCHORS for s in range(n - w + 1)}
    for p in rank:  # rarest first; a place serves every window it lies in that still wants one
        want = [s for s in range(max(0, p - w + 1), min(p, n - w) + 1) if left[s]]
        if want:
            out.add(p)
            for s in want:
                left[s] -= 1
    return out


def term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(term, n) over all documents for the terms of a broadcast set; one partial row per term and task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = vocabulary.value, Counter()
        for _, texts in small_batches(batches):
            for t in texts:
                seen.update(filter(wanted.__contains__, ALNUM.findall(lower_bytes(t))))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["term", "n"])
    return docs.select("doc_id", "text").mapInArrow(count, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms) -> DataFrame:
    """Documents with their postings: doc_id, text_hash, n_words, postings array<struct<term,positions>>; terms: broadcast word -> number."""
    schema = "doc_id bigint, text_hash bigint, n_words bigint, postings array<struct<term:int,positions:array<int>>>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = terms.value
        kind = pa.list_(pa.struct([("term", pa.int32()), ("positions", pa.list_(pa.int32()))]))
        for ids, hashes, texts in small_batches(batches):
            sizes, lists = [], []
            for t in texts:
                words = ALNUM.findall(lower_bytes(t))
                at: dict[int, list[int]] = {}
                for p in compress(range(len(words)), map(number.__contains__, words)):
                    at.setdefault(number[words[p]], []).append(p)
                sizes.append(len(words))
                lists.append([{"term": k, "positions": v} for k, v in at.items()])
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lists, kind)],
                                             names=["doc_id", "text_hash", "n_words", "postings"])
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(index, schema)


def inverted(found: DataFrame) -> DataFrame:
    """(term, doc_id, text_hash, positions): the postings as lists by term, each document once, in ranges of (term, document)."""
    one = found.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode("postings").alias("p"))
    lists = one.select(F.col("p.term").alias("term"), "doc_id", "text_hash", F.col("p.positions").alias("positions"))
    return cut_lineage(lists.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))


def alignments(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, text_hash, passage, anchor, start): every posting of an anchor's term, moved by the anchor's place."""
    each = index.select("doc_id", "text_hash", "term", F.explode("positions").alias("at"))
    return each.join(F.broadcast(anchors), "term").select("doc_id", "text_hash", "passage", "anchor", (F.col("at") - F.col("anchor")).alias("start"))


def proximity_matches(aligned: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, text_hash, passage): most anchors of the passage within SLOP words of their places."""
    bands = F.explode(F.array(F.floor(F.col("start") / (2 * SLOP)) * 2, F.floor((F.col("start") + SLOP) / (2 * SLOP)) * 2 + 1)).alias("band")
    near = aligned.select("doc_id", "text_hash", "passage", "anchor", bands).distinct().groupBy("doc_id", "text_hash", "passage", "band").agg(F.count(F.lit(1)).alias("n"))
    return near.join(F.broadcast(sizes), "passage").filter((F.col("n") >= 2) & (F.col("n") >= NEAR_SHARE * F.col("n_anchors"))).select("doc_id", "text_hash", "passage").distinct()


def hit_words(words: list[bytes], passages: list[list[bytes]], starts: list[tuple[int, int]]) -> tuple[set[int], set[int]]:
    """(positions hit, passages with an occurring window) among candidate (passage, start) alignments."""
    hit: set[int] = set()
    found: set[int] = set()
    n = len(words)
    for k, start in starts:
        item = passages[k]
        w, run = min(WINDOW, len(item)), 0
        for p in range(max(0, -start), min(len(item), n - start)):
            run = run + 1 if words[start + p] == item[p] else 0
            if run >= w:
                found.add(k)
                hit.update(range(start + p - w + 1, start + p + 1) if run == w else (start + p,))
    return hit, found


def _check(items) -> Callable:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = items.value
        for ids, hashes, texts, cands in small_batches(batches, 64):
            hits, found = [], []
            for t, c in zip(texts, cands):
                h, f = hit_words(ALNUM.findall(lower_bytes(t)), passages, [(x["passage"], x["start"]) for x in c])
                hits.append(sorted(h))
                found.append(sorted(f))
            yield pa.RecordBatch.from_arrays([ids, pa.array(hashes, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int32()))],
                                             names=["doc_id", "text_hash", "hits", "passages"])
    return check


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, text_hash, n_words, hits (sorted positions), items (ids), near_items (ids), null_item (an item without id occurs)."""
    spark = docs.sparkSession
    docs = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"coalesce(cast(`{text_col}` as string), '') as text")
    items = cut_lineage(item_blocks(benchmark, item_col, item_text_col))
    rows, parts = None, []
    for b in sorted(r.block for r in items.select("block").distinct().collect()) or [0]:
        block = items.filter(F.col("block") == b).select("item", "words").collect()  # less than 2 * BLOCK_WORDS words
        passages = [[w.encode("utf-8", "surrogatepass") for w in r.words] for r in block]
        names = [r.item for r in block]
        vocabulary = spark.sparkContext.broadcast({w for p in passages for w in p})
        counts = {bytes(r.term): r.n for r in term_counts(docs, vocabulary).collect()} if passages else {}
        places = [(k, sorted(anchors_of(p, counts))) for k, p in enumerate(passages)]
        words = sorted({passages[k][a] for k, at in places for a in at})
        number = {w: i for i, w in enumerate(words)}
        found = cut_lineage(postings(docs, spark.sparkContext.broadcast(number)))
        rows = found.select("doc_id", "text_hash", "n_words") if rows is None else rows
        index = inverted(found)
        anchors = spark.createDataFrame(pa.table({"term": pa.array([number[passages[k][a]] for k, at in places for a in at], pa.int32()),
                                                  "passage": pa.array([k for k, at in places for _ in at], pa.int32()), "anchor": pa.array([a for _, at in places for a in at], pa.int32())}))
        sizes = spark.createDataFrame(pa.table({"passage": pa.array([k for k, _ in places], pa.int32()), "item": pa.array(names, pa.string()),
                                                "n_anchors": pa.array([len(at) for _, at in places], pa.int32()), "need": pa.array([min(ANCHORS, len(passages[k])) for k, _ in places], pa.int32())}))
        aligned = cut_lineage(alignments(index, anchors))
        agreeing = aligned.groupBy("doc_id", "text_hash", "passage", "start").agg(F.count(F.lit(1)).alias("n"))
        cands = agreeing.join(F.broadcast(sizes), "passage").filter("n >= need").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("passage", "start")).alias("cands"))
        texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.text_hash") == F.col("c.text_hash"))
        checked = cut_lineage(texts.alias("t").join(cands.alias("c"), same).select("t.doc_id", "t.text_hash", "text", "cands").mapInArrow(
            _check(spark.sparkContext.broadcast(passages)), "doc_id bigint, text_hash bigint, hits array<int>, passages array<int>").dropDuplicates(["doc_id", "text_hash"]))
        exact = checked.select("doc_id", "text_hash", F.explode("passages").alias("passage")).join(F.broadcast(sizes), "passage").groupBy("doc_id", "text_hash").agg(F.collect_set("item").alias("items"))
        near = proximity_matches(aligned, sizes.select("passage", "n_anchors")).join(F.broadcast(sizes), "passage").groupBy("doc_id", "text_hash").agg(F.collect_set("item").alias("near_items"))
        key = ["doc_id", "text_hash"]
        parts.append(checked.select(*key, "hits", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<string>").alias("near_items"))
                     .unionByName(exact.select(*key, F.lit(None).cast("array<int>").alias("hits"), "items", F.lit(None).cast("array<string>").alias("near_items")))
                     .unionByName(near.select(*key, F.lit(None).cast("array<int>").alias("hits"), F.lit(None).cast("array<string>").alias("items"), "near_items")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731  what blocks found of one document, without nulls
    every = every.groupBy("doc_id", "text_hash").agg(flat("hits"), flat("items"), flat("near_items"))
    empty = lambda c, t: F.array_sort(F.coalesce(c, F.array().cast(f"array<{t}>"))).alias(c)
    on = rows.alias("r").join(every.alias("e"), F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("r.text_hash") == F.col("e.text_hash")), "left")
    out = on.select("r.doc_id", "r.text_hash", "n_words", empty("hits", "int"), empty("items", "string"), empty("near_items", "string"))
    ids = lambda c: F.transform(F.filter(c, lambda x: x != ""), lambda x: F.substr(x, F.lit(2))).alias(c)
    return out.select("doc_id", "text_hash", "n_words", "hits", ids("items"), ids("near_items"), F.array_contains("items", "").alias("null_item"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the document's words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op4(spark, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.size("hits").cast("bigint")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), (F.size("items") + F.col("null_item").cast("int")).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(n_hit, F.col("n_words")).alias("contaminated"),
                      F.size("near_items").cast("bigint").alias("n_near_items"))
