"""Near-duplicate groups by an LSH forest over MinHash signatures, every link confirmed on the full shingle sets.

A document's set: its distinct shingles of five words (A-Z lower-cased); with fewer words the whole sequence is the one
shingle; without words the set is empty and linked with nothing. Two documents are linked when their sets' Jaccard
similarity is at least 0.75, and a group is a connected component of links.

1. *Classes.* Documents with the same set share a digest and are one class, represented by the least id, so copies are
   counted by a map-side reduced aggregate and never paired.
2. *Forest.* The signature of 48 minima is read from 24 starting places, which gives 24 sorted orders. Neighbours in an
   order that share a prefix of at least two minima are candidates; a pair at 0.75 has such a prefix in no order with
   probability (1 - 0.75^2)^24 = 2e-9. The prefix is as deep as a region needs: while a region of an order holds more
   than `REGION_ROWS` classes or `REGION_SHINGLES` shingles, its prefix grows. Classes that agree on the whole signature
   and are still too many are dealt over blocks that all hold the region's least class as a hub.
3. *Confirm.* A region is bounded, so it meets in one task: first its signatures, which drop the members without a partner
   of another group that size and signature allow (22 of 48 minima: 4.8 standard deviations below 0.75), then the texts of
   the others. There a pair is looked at only while its two classes are in different groups, and then on the full sets. What leaves the task are the links that joined groups, at most one per class: never all pairs.
4. *Rounds.* Two orders first; then the others, but only regions in which several groups still meet; then, in 12 orders,
   what longer prefixes parted: in a crowded region every class outside its largest group meets all others, in blocks.
5. *Components* by star contraction over the links.

Defined cases: null and empty texts have no set: component is the own id, kept. Null ids are linked with nothing and
kept, their component is null. Repeated rows and rows that share an id belong to one node; each row gets its own result.
Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footreach.llm.batches import WordHashes, lower_bytes, small_batches
from footreach.llm.components import component_roots
from footreach.session import cut_lineage

SHINGLE, NUM, DEN = 5, 75, 100
HASHES, ORDERS, FIRST_ORDERS, REST_ORDERS, MIN_AGREE = 48, 24, 2, 12, 22
DEPTHS = (2, 4, 8, 16, 48)
REGION_ROWS, REGION_SHINGLES, ALWAYS_ROWS = 1500, 1_500_000, 8
_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of lower-cased bytes."""
    words = text.split()
    n = len(words)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64) if n else np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    m = n - SHINGLE + 1
    key = h[:m].copy()
    for k in range(1, SHINGLE):
        key ^= key >> np.uint64(31)
        key *= _M1
        key += h[k:m + k]
    key ^= key >> np.uint64(32)
    key *= _M2
    key ^= key >> np.uint64(29)
    key.sort()
    return key[np.concatenate(([True], key[1:] != key[:-1]))]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima under HASHES permutations of 32-bit values; a set of any size in steps of 1024 shingles."""
    s = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 1024):
        np.minimum(out, (s[at:at + 1024] * _A + _B).min(axis=1), out=out)
    return out


SIGNED = "doc_id bigint, n_shingles bigint, digest binary, sig array<int>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for ids, texts in small_batches(batches):
        sizes, digests, sigs = [], [], []
        for t in texts:
            s = shingle_set(lower_bytes(t), hashes)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sigs.append(signature(s).view(np.int32))
        flat = pa.array(np.concatenate(sigs))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * HASHES), flat)],
            names=["doc_id", "n_shingles", "digest", "sig"])


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature: one row per row."""
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(_sign, SIGNED)


def _deeper(key, order, sig, at: int):
    """The key of a prefix one minimum longer: minimum number `at` of the order that starts at 2 * order."""
    return F.xxhash64(key, F.element_at(sig, ((order * 2 + at) % HASHES) + 1))


def regions(classes: DataFrame, first: int, last: int) -> DataFrame:
    """(key, order, rep, digest, label): classes by region of orders first..last-1, where at least two groups meet.

    `classes`: rep, digest, n_shingles, sig, label. Rows that carry the signature are only those of crowded regions.
    """
    orders = F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("order")
    rows = classes.select("rep", "digest", "n_shingles", "label", "sig", orders)
    key = _deeper(_deeper(F.col("order"), F.col("order"), F.col("sig"), 0), F.col("order"), F.col("sig"), 1)
    rows = rows.select("rep", "digest", "n_shingles", "label", "order", key.alias("key"))
    sigs = classes.select(F.col("rep").alias("_rep"), F.col("digest").alias("_digest"), "sig")
    parts = []
    for now, then in zip(DEPTHS, (*DEPTHS[1:], None)):
        stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("shingles"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("rep").alias("hub"))
        crowded = (F.col("rows") > ALWAYS_ROWS) & ((F.col("rows") > REGION_ROWS) | (F.col("shingles") > REGION_SHINGLES))
        met = cut_lineage(rows.join(stats.filter("rows > 1 and l0 <> l1").select("key", "rows", "shingles", "hub", crowded.alias("crowded")), "key"))
        parts.append(met.filter(~F.col("crowded")).select("key", "order", "rep", "digest", "label"))
        full = met.filter("crowded")
        if full.isEmpty():
            break
        if then is None:
            n = F.ceil(F.greatest(F.col("rows") * 2.0 / REGION_ROWS, F.col("shingles") * 2.0 / REGION_SHINGLES)).cast("int")
            block = F.when(F.col("rep") == F.col("hub"), F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), n).cast("int")))
            parts.append(full.withColumn("block", F.explode(block)).select(F.xxhash64("key", "block").alias("key"), "order", "rep", "digest", "label"))
            break
        carried = full.join(sigs, (F.col("rep") == F.col("_rep")) & (F.col("digest") == F.col("_digest")))
        key = F.col("key")
        for at in range(now, then):
            key = _deeper(key, F.col("order"), F.col("sig"), at)
        rows = carried.select("rep", "digest", "n_shingles", "label", "order", key.alias("key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def crowded_rest(classes: DataFrame, last: int) -> DataFrame:
    """(key, order, rep, digest, label): what longer prefixes may have parted in crowded regions, so that nothing is lost there.

    Of two classes in different groups of a region at least one is outside the region's largest group: a stray. Blocks of
    strays meet blocks of all classes of the region, each pair of blocks under a key of its own.
    """
    orders = F.explode(F.sequence(F.lit(0), F.lit(last - 1))).alias("order")
    rows = classes.select("rep", "digest", "n_shingles", "label", "sig", orders)
    key = _deeper(_deeper(F.col("order"), F.col("order"), F.col("sig"), 0), F.col("order"), F.col("sig"), 1)
    rows = rows.select("rep", "digest", "n_shingles", "label", "order", key.alias("key"))
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    stats = sizes.groupBy("key").agg(F.sum("n").alias("rows"), F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("groups"), F.max_by("label", "n").alias("largest"), (F.sum("n") - F.max("n")).alias("strays"))
    crowded = stats.filter((F.col("groups") > 1) & (F.col("rows") > ALWAYS_ROWS) & ((F.col("rows") > REGION_ROWS) | (F.col("shingles") > REGION_SHINGLES)))
    size = F.least(F.lit(REGION_ROWS), F.greatest(F.lit(1), F.floor(F.lit(REGION_SHINGLES) * F.col("rows") / F.col("shingles")).cast("int")))
    met = rows.select("key", "order", "rep", "digest", "label").join(crowded.select("key", "largest", F.ceil(F.col("rows") / size).cast("int").alias("blocks"), F.ceil(F.col("strays") / size).cast("int").alias("stray_blocks")), "key")
    own, stray = F.pmod(F.xxhash64("rep"), F.col("blocks")), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("stray_blocks"))
    every = met.select("key", "order", "rep", "digest", "label", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("stray"))
    strays = met.filter(F.col("label") != F.col("largest")).select("key", "order", "rep", "digest", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), stray.alias("stray"))
    return every.unionByName(strays.select("key", "order", "rep", "digest", "label", F.col("block").cast("bigint").alias("block"), F.col("stray").cast("int").alias("stray"))).select(
        F.xxhash64("key", F.col("block").cast("bigint"), F.col("stray").cast("bigint")).alias("key"), "order", "rep", "digest", "label")


def region_links(labels: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Groups that links inside one region join; every pair of classes of different groups that may reach 0.75 is confirmed."""
    root = {x: x for x in labels}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    n = np.array([len(s) for s in sets])
    sigs = np.stack([signature(s) for s in sets])
    out = []
    for i in range(1, len(sets)):
        agree = (sigs[:i] == sigs[i]).sum(axis=1)
        may = np.flatnonzero((agree >= MIN_AGREE) & (DEN * np.minimum(n[:i], n[i]) >= NUM * np.maximum(n[:i], n[i])))
        for j in may[np.argsort(-agree[may], kind="stable")].tolist():
            a, b = find(labels[i]), find(labels[j])
            if a == b:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if DEN * both >= NUM * (int(n[i]) + int(n[j]) - both):
                root[max(a, b)] = min(a, b)
                out.append((a, b))
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: one region at a time is in memory."""
    hashes = WordHashes()
    key, seen, labels, sets = None, set(), [], []

    def links() -> list[tuple[int, int]]:
        return region_links(labels, sets) if len(sets) > 1 else []

    out: list[tuple[int, int]] = []
    for keys, ids, digests, own, texts in small_batches(batches):
        for k, rep, digest, label, text in zip(keys.to_pylist(), ids, digests, own, texts):
            if k != key:
                out += links()
                key, seen, labels, sets = k, set(), [], []
            if (rep, digest) in seen:
                continue
            s = shingle_set(lower_bytes(text), hashes)
            if xxhash.xxh3_128_digest(s.tobytes()) == digest:  # another row may share the id but not the text
                seen.add((rep, digest))
                labels.append(label)
                sets.append(s)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
            out = []
    out += links()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; those that have a partner of another group in their region which size and signature allow.

    A pair that shares a region in several orders is looked at in the first one only. Had a longer prefix parted it there,
    that region was crowded, and `crowded_rest` sees to it in the orders below REST_ORDERS.
    """
    key, rows = None, []

    def some() -> list[tuple]:
        if len(rows) < 2:
            return []
        sigs, n, label = np.array([r[5] for r in rows]), np.array([r[4] for r in rows]), np.array([r[3] for r in rows])
        good = np.zeros(len(rows), bool)
        labels, sizes = np.unique(label, return_counts=True)
        order = rows[0][6]
        for i in np.flatnonzero(label != labels[sizes.argmax()]):  # a pair of different groups has one that is not of the largest
            same = sigs == sigs[i]
            may = np.flatnonzero((same.sum(axis=1) >= MIN_AGREE) & (label != label[i]) & (DEN * np.minimum(n, n[i]) >= NUM * np.maximum(n, n[i])))
            met = (same[may, 0::2] & same[may, 1::2])[:, :min(order, REST_ORDERS)].any(axis=1)  # an earlier order has looked at the pair
            good[may[~met]] = True
            good[i] |= not met.all()
        return [rows[i][:4] for i in np.flatnonzero(good)]

    names, kinds = ["key", "rep", "digest", "label"], [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    out: list[tuple] = []
    for keys, *cols in small_batches(batches, 2048):
        for row in zip(keys.to_pylist(), *cols):
            if row[0] != key:
                out += some()
                key, rows = row[0], []
            rows.append(row)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out = []
    out += some()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def promising(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members whose texts are worth sending: signatures (192 bytes) meet in the regions first."""
    signed = members.join(classes.select("rep", "digest", "n_shingles", "sig"), ["rep", "digest"]).select("key", "rep", "digest", "label", "n_shingles", "sig", "order")
    return signed.repartition("key").sortWithinPartitions("key").mapInArrow(_promising, "key bigint, rep bigint, digest binary, label bigint")


def confirmed_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v) between groups, from regions; texts of promising members travel, nothing else does.

    Always by sort-merge: with few members Spark would broadcast them and not deal the texts, a plan that ends at some size.
    """
    text = members.hint("merge").join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep").select("key", "rep", "digest", "label", "text")
    return text.repartition("key").sortWithinPartitions("key").mapInArrow(_confirm, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id, kept, class_id (the least id with the same set)."""
    docs = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    rows = cut_lineage(signed(docs))
    usable = rows.filter("n_shingles > 0 and doc_id is not null")
    least = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    labelled = cut_lineage(usable.withColumnRenamed("doc_id", "rep").join(least, ["digest", "rep"], "left_semi").dropDuplicates(["digest", "rep"]).withColumn("label", F.col("rep")))
    same_id = usable.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).filter("d0 <> d1").select("doc_id")
    parts = [usable.join(same_id, "doc_id", "left_semi").join(least, "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))]
    for step in (lambda c: regions(c, 0, FIRST_ORDERS), lambda c: regions(c, FIRST_ORDERS, ORDERS), lambda c: crowded_rest(c, REST_ORDERS)):
        members = cut_lineage(promising(step(labelled), labelled))
        if not members.isEmpty():
            parts.append(confirmed_links(members, docs))
        if not parts:
            continue
        found = cut_lineage(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        parts = []
        if not found.isEmpty():  # links join groups, so only groups go into the components, and their classes are named anew
            labelled = cut_lineage(labelled.join(component_roots(found), F.col("label") == F.col("node"), "left").withColumn("label", F.coalesce("component", "label")).drop("node", "component"))
    by_id = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest"))
    out = by_id.join(labelled.select("digest", "rep", "label"), "digest", "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"))


def op8(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
