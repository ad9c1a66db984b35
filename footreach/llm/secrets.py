"""Secret scans with corpus-wide ownership frequency. Built-in expressions only.

Spans: three base kinds by pattern (assign, access, hex), and further kinds of key-like strings that the corpus decides
about: every candidate's hash is counted over distinct repositories, distinct owners and distinct texts. A value that
several owners carry is a widely copied example; one that belongs to one owner, or to few owners in few texts, and has
the mixed look of a live key is taken for an owner's credential and becomes a span. Base spans always stay.

A value of one owner is live in however many documents it stands. A value that stands in one distinct text only is live
too: its copies are copies of the document, not of the value. For two owners the limit is `MAX_REPOSITORIES` distinct
texts, or `REPOSITORY_SHARE` of the corpus's distinct texts where that is more.

Counts are of (hash, owner, repository) triples reduced twice with map-side sums, and of (hash, text digest) pairs, so a
value that a third of all rows carries arrives as a few partial rows; the verdict goes back to the documents by a join on
the hash that is dealt by (hash, salt) for hot values.

Defined cases: a null text is empty; repeated rows stay one result row each; null owners count as one owner; other
columns are ignored, whatever their names; an empty table gives an empty table.
Positions are code points from 0, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.session import cut_lineage

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Key forms with a public prefix, and long mixed strings. Candidates only: ownership decides.
KEYED = r"(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk|pk|rk)[_-][A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|[A-Za-z0-9+/_-]{24,}={0,2}"
KINDS = ("assign", "access", "hex", "key")
MAX_OWNERS, MAX_REPOSITORIES, REPOSITORY_SHARE, SALTS = 2, 50, 0.005, 16


def found(text: Column, pattern: str, kind: int, value_group: int | None = None, least: int = 0) -> Column:
    """array<struct<start,rank,end,value>> of the leftmost non-overlapping matches, without those whose value is short.

    The pieces between matches and the matches themselves give all positions by one running sum over their lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = whole if value_group is None else F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(value_group + 1))
    gaps = F.split(text, pattern, -1)
    step = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>").alias("got"))

    def take(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("rank"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["got"], span)).otherwise(acc["got"]).alias("got"))

    hits = F.zip_with(F.zip_with(whole, value, lambda h, v: F.struct(h.alias("hit"), v.alias("value"))), F.slice(gaps, F.lit(1), F.size(whole)),
                      lambda h, g: F.struct(h["hit"].alias("hit"), h["value"].alias("value"), g.alias("gap")))
    return F.aggregate(hits, step, take, lambda acc: acc["got"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")


def candidate_spans(docs: DataFrame, *, id_col: str, text_col: str, owner_col: str, repo_col: str, keep: list[str] = ()) -> DataFrame:
    """One row per document row: row number, id, owner, repo, text digest, kept columns as one struct, base spans, key candidates outside them."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    low = F.lower(text)
    some = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    d = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
                    F.col(repo_col).cast("string").alias("repo"), F.col(text_col).cast("string").alias("_text"))
    d = d.select("row", "kept", "doc_id", "owner", "repo", F.xxhash64(text).alias("digest"),
                 F.when(some, found(text, ASSIGN, 0, 1, 12)).otherwise(_none()).alias("assign"),
                 F.when(text.contains("AKIA"), found(text, ACCESS, 1)).otherwise(_none()).alias("access"),
                 F.when(text.rlike(HEX), found(text, HEX, 2)).otherwise(_none()).alias("hex"),
                 F.when(text.rlike(KEYED), found(text, KEYED, 3)).otherwise(_none()).alias("key"))
    base = F.concat("assign", "access", "hex")
    apart = F.filter("key", lambda k: ~F.exists(base, lambda b: (b["start"] < k["end"]) & (k["start"] < b["end"])))
    return d.select("row", "kept", "doc_id", "owner", "repo", "digest", F.size("assign").cast("bigint").alias("n_assign"), F.size("access").cast("bigint").alias("n_access"),
                    F.size("hex").cast("bigint").alias("n_hex"), F.array_sort(base).alias("base"), F.filter(apart, lambda k: looks_live(k["value"])).alias("key"))


def looks_live(value: Column) -> Column:
    """The mixed look of a key: digits, both cases, and few repeats among its characters."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]") & (distinct >= 12)


def ownership(spans: DataFrame) -> DataFrame:
    """hash, owners, repositories, texts of every candidate value, over the whole corpus."""
    each = spans.select("owner", "repo", "digest", F.explode(F.concat("base", "key")).alias("s")).select("owner", "repo", "digest", F.sha2(F.col("s.value"), 256).alias("hash"))
    triples = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    pairs = triples.groupBy("hash", "owner").agg(F.sum("one").alias("repos"))
    texts = each.groupBy("hash", "digest").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("texts"))
    return pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories")).join(texts, "hash")


SPANS = "array<struct<start:int,rank:int,end:int,owners:bigint,repositories:bigint,live:boolean>>"


def judged_spans(rows: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """(row, spans) of the rows that have any: base spans with their verdict, and the further ones that look live."""
    limit = max(max_repositories, REPOSITORY_SHARE * rows.select("digest").distinct().count())
    carriers = F.when(F.col("texts") == 1, 1).otherwise(F.col("owners"))
    owned = ownership(rows).withColumn("live", (carriers <= max_owners) & ((carriers == 1) | (F.col("texts") <= limit))).drop("texts")
    each = rows.select("row", F.explode(F.concat("base", "key")).alias("s")).select(
        "row", "s.start", "s.rank", "s.end", F.sha2(F.col("s.value"), 256).alias("hash"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    dealt = owned.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return each.join(dealt, ["hash", "salt"]).filter((F.col("rank") < 3) | F.col("live")).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "owners", "repositories", "live"))).cast(SPANS).alias("spans"))


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
                 max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per document row: counts and spans of the base kinds, and all spans with their ownership verdict.

    `spans`: array<struct<start,rank,end,owners,repositories,live>>, rank being the place in KINDS; `live` is false for
    widely copied values.
    """
    rows = cut_lineage(candidate_spans(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col))
    judged = judged_spans(rows, max_owners, max_repositories)
    return rows.select("row", "doc_id", "n_assign", "n_access", "n_hex", "base").join(judged, "row", "left").select(
        "row", "doc_id", "n_assign", "n_access", "n_hex", "base", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redact_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id",
                   max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """The documents with live spans replaced; rows without any candidate pass through without a shuffle."""
    rows = cut_lineage(candidate_spans(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col, keep=docs.columns))
    some = (F.size("base") > 0) | (F.size("key") > 0)
    clean = rows.filter(~some).select("kept.*")
    changed = rows.filter(some).select("row", "kept").join(judged_spans(rows, max_owners, max_repositories), "row", "left")
    text = redact(F.col(f"kept.`{text_col}`"), F.coalesce("spans", F.array().cast(SPANS)))
    return clean.unionByName(changed.withColumn("kept", F.col("kept").withField(f"`{text_col}`", text)).select("kept.*"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in the spans' order."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every live span replaced by `<secret>`; overlapping spans are one. Widely copied values stay."""
    live = F.filter(spans, lambda s: s["live"])
    step = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("<secret>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(live) == 0, text).otherwise(
        F.aggregate(live, step, cut, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1))))


def op9(spark, sf_dir: str) -> DataFrame:
    out = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
                      F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"))
