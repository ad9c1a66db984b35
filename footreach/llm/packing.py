"""Best-fit packing of documents into sequences of fixed length under conflicts.

A bin must not hold two pieces of one duplicate cluster, nor more than `per_source` pieces of one source. Each bin carries
a bitmap of its clusters and one bitmap per allowed piece of a source (a piece takes the first plane in which its source's
bit is free). Bins are kept in the order of their residual room. A piece is put into the tightest bin that fits and is
compatible: the search starts at the least residual that holds the piece and goes on to its successors until one is
compatible; only if none is, a new bin is opened. Pieces come in falling size (best-fit decreasing).

Documents longer than a bin are cut: full pieces are bins of their own, the remainder is packed.

Rows are dealt round-robin over shards of about `SHARD_ROWS`, so a hot source or cluster is spread like any other; a shard
is packed by itself, and the waste is at most a part-filled tail per shard. Only ids, lengths, a source and a 64-bit
cluster key travel, never texts.

Defined cases: null or empty texts have no piece and come out once, without a bin; null sources are one source; a null
cluster is a cluster of its own; repeated rows are packed each; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, PER_SOURCE, SHARD_ROWS = 2048, 2, 4000
SCHEMA = "doc_id bigint, piece int, piece_start bigint, piece_length bigint, bin_id bigint, bin_offset bigint"
BINS_PER_SHARD = 1 << 32


def pack(pieces: list[tuple[int, object, object]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of every (length, source, cluster); lengths from 1 to capacity, a cluster of None conflicts with nothing."""
    seen = Counter(c for _, _, c in pieces)
    bits: dict = {}
    source_bit: dict = {}
    room: list[tuple[int, int]] = []  # (residual, bin), in order
    planes: list[list[int]] = []
    clusters: list[int] = []
    out = [(-1, -1)] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        n, source, cluster = pieces[i]
        s = source_bit.setdefault(source, 1 << len(source_bit))
        c = 0 if cluster is None or seen[cluster] < 2 else bits.setdefault(cluster, 1 << len(bits))
        at = bisect_left(room, (n, -1))
        while at < len(room):
            b = room[at][1]
            if not clusters[b] & c and any(not p & s for p in planes[b]):
                break
            at += 1
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(planes)
            planes.append([0] * per_source)
            clusters.append(0)
        out[i] = (b, capacity - left)
        clusters[b] |= c
        k = next(k for k, p in enumerate(planes[b]) if not p & s)
        planes[b][k] |= s
        if left > n:
            insort(room, (left - n, b))
    return out


def packed(docs: DataFrame, *, id_col: str = "doc_id", length: Column | None = None, source: Column | None = None, cluster: Column | None = None,
           capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> DataFrame:
    """doc_id, piece, piece_start, piece_length, bin_id, bin_offset. Defaults: words of `text`, `source`, copies of `text`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")) if length is None else length
    source = F.col("source") if source is None else source
    cluster = F.xxhash64(F.lower(text)) if cluster is None else cluster
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(length.cast("bigint"), F.lit(0).cast("bigint")).alias("n"), source.cast("string").alias("source"), cluster.cast("bigint").alias("cluster"))
    shards = max(1, -(-docs.count() // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id() * 7919, F.lit(shards)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def done() -> pa.RecordBatch:
            small, rows = [], []
            for doc, n, src, clu in group:
                full, rest = divmod(n, capacity)
                for k in range(full):
                    rows.append([doc, k, k * capacity, capacity, None, 0])
                if rest:
                    small.append((len(rows), (rest, src, clu)))
                    rows.append([doc, full, full * capacity, rest, None, 0])
                if not n:
                    rows.append([doc, 0, 0, 0, None, None])
            bins = 0
            for (r, _), (b, at) in zip(small, pack([p for _, p in small], capacity, per_source)):
                rows[r][4:] = [b, at]
                bins = max(bins, b + 1)
            for r in rows:
                if r[4] is None and r[3]:
                    r[4], bins = bins, bins + 1
                if r[4] is not None:
                    r[4] += key * BINS_PER_SHARD
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.strip().split(" ")[0] for c in SCHEMA.split(",")])

        for batch in batches:
            for shard, *row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if shard != key:
                    if group:
                        yield done()
                    key, group = shard, []
                group.append(row)
        if group:
            yield done()

    return (dealt.select("shard", "doc_id", "n", "source", "cluster").repartition("shard").sortWithinPartitions("shard", F.desc("n"), "doc_id", "cluster", "source")
            .mapInArrow(fill, SCHEMA))


def op7(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
