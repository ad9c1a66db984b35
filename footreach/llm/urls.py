"""URL filters: host/path rules, and a path-template tree judged by smoothed labelled purity. Built-in expressions only.

Per host the path segments form a tree. (1) *Generalise*: a segment whose form is variable (a number, a hex or uuid form,
four digits or more, over 40 characters) becomes ``*`` with its file ending kept; then, level by level, a node whose
children are many and each rarely seen gets one child ``*`` instead. (2) *Merge*: branches below one node whose share of
bad labels does not differ significantly from that of their siblings together become one branch; the others stay alone.
(3) *Judge*: a branch is rejected when its share of bad labels, smoothed towards the host's and the host's towards the
corpus's, reaches a threshold. A branch without labels is never rejected.

Rows are counted per (host, template) before anything is joined, so a hot host costs its distinct templates, not its
rows. Levels go to the greatest depth there is; a node with too few paths below it to be generalised is done with at once,
so long rare paths cost no level of their own.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated rows
stay; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.session import cut_lineage

#: (verdict, host and path): a rule holds for the host and all its subdomains when the path starts with its path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_CHILDREN, MAX_MEAN_VISITS = 8, 4.0
SIMILAR_Z, PRIOR_WEIGHT, BLOCK_PURITY, MIN_LABELLED = 1.96, 4.0, 0.8, 5
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UP, _LOW), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. For rule lists that fit a plan; ties: the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Path segments with variable forms generalised."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    def form(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
        stem = F.substr(s, F.lit(1), F.length(s) - F.length(ending))
        variable = stem.rlike(r"^[0-9]+$|[0-9]{4}|^[0-9a-fA-F-]{8,}$") | (F.length(stem) > 40)
        return F.when(variable, F.concat(F.lit("*"), ending)).otherwise(s)
    return F.transform(parts, form)


def template_tree(pages: DataFrame) -> DataFrame:
    """(host, path segments) counted, with variable levels generalised: host, raw, template, n, n_labelled, n_bad.

    `pages`: host, raw (array of segments), bad (1, 0 or null where unlabelled).
    """
    t = pages.groupBy("host", "raw").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_labelled"), F.sum(F.coalesce("bad", F.lit(0))).alias("n_bad"))
    t = cut_lineage(t.withColumn("template", F.array().cast("array<string>")))
    done, level = [], 0
    while not t.isEmpty():  # each level is a written table: the plan stays short and the next level knows its size
        level += 1
        seen = F.try_element_at("raw", F.lit(level))
        children = t.filter(seen.isNotNull()).groupBy("host", "template", seen.alias("_child")).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_raws"))
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_children"), F.sum("_n").alias("_visits"), F.sum("_raws").alias("_paths")).filter(
            F.col("_paths") >= MIN_CHILDREN).select("host", "template", ((F.col("_children") >= MIN_CHILDREN) & (F.col("_visits") <= MAX_MEAN_VISITS * F.col("_children"))).alias("_wide"))
        step = F.when(F.col("_wide") & ~seen.startswith("*"), F.lit("*")).otherwise(seen)
        rest = F.slice("raw", F.lit(level), F.greatest(F.size("raw") - level + 1, F.lit(0)))
        open_end = seen.isNotNull() & F.col("_wide").isNotNull()
        t = cut_lineage(t.join(nodes, ["host", "template"], "left").withColumn("_open", open_end).withColumn(
            "template", F.concat("template", F.when(F.col("_open"), F.array(step)).otherwise(rest))).drop("_wide"))
        done.append(t.filter("not _open").drop("_open"))
        t = t.filter("_open").drop("_open")
    out = t
    for x in done:
        out = out.unionByName(x)
    return out


def judged_branches(tree: DataFrame) -> DataFrame:
    """host, template, branch, purity, n_labelled, rejected: similar siblings merged, purity smoothed."""
    leaf = tree.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("n_labelled").alias("l"), F.sum("n_bad").alias("b"))
    node = F.when(F.size("template") > 0, F.slice("template", F.lit(1), F.size("template") - 1)).otherwise(F.col("template"))
    leaf = leaf.withColumn("node", node)
    pooled = leaf.groupBy("host", "node").agg(F.sum("l").alias("_l"), F.sum("b").alias("_b"))
    host = leaf.groupBy("host").agg(F.sum("l").alias("_hl"), F.sum("b").alias("_hb"))
    everything = leaf.agg(F.try_divide(F.sum("b").cast("double"), F.sum("l").cast("double")).alias("p")).select("p")
    share = F.try_divide(F.col("_b").cast("double"), F.col("_l").cast("double"))
    off = F.try_divide(F.col("b") - F.col("l") * share, F.sqrt(F.col("l") * share * (1 - share)))
    apart = (F.col("l") > 0) & (F.abs(off) > SIMILAR_Z)
    marked = leaf.join(pooled, ["host", "node"]).withColumn("branch", F.when(apart, F.array_join("template", "/")).otherwise(
        F.concat(F.array_join("node", "/"), F.lit("/+")))).select("host", "template", "branch", "n", "l", "b")
    merged = marked.groupBy("host", "branch").agg(F.sum("l").alias("n_labelled"), F.sum("b").alias("n_bad")).join(host, "host")
    prior = F.coalesce(everything.scalar(), F.lit(0.0))
    above = (F.col("_hb") + PRIOR_WEIGHT * prior) / (F.col("_hl") + PRIOR_WEIGHT)
    purity = (F.col("n_bad") + PRIOR_WEIGHT * above) / (F.col("n_labelled") + PRIOR_WEIGHT)
    merged = merged.withColumn("purity", purity).withColumn("rejected", (F.col("n_labelled") >= MIN_LABELLED) & (F.col("purity") >= BLOCK_PURITY))
    return marked.select("host", "template", "branch").join(merged.select("host", "branch", "purity", "n_labelled", "rejected"), ["host", "branch"])


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: a rule's verdict where one fits, else the tree's.

    `labels` (page_id, bad 0/1) are the labelled pages; without it the pages that a rule decides are the labelled ones.
    """
    host, path = split_url(F.col("_url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url")).select(
        "page_id", host.alias("host"), path.alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("_said", said).withColumn("raw", segments(F.col("path")))
    if labels is None:
        known = base.withColumn("bad", F.when(F.col("_said").isNotNull(), (F.col("_said") == "block").cast("int")))
    else:
        one = labels.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
        known = base.join(one, "page_id", "left")
    tree = template_tree(known.select("host", "raw", "bad"))
    verdicts = tree.select("host", "raw", "template").join(judged_branches(tree), ["host", "template"])
    out = base.join(verdicts, ["host", "raw"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.coalesce("rejected", F.lit(False)), "block").otherwise("allow")).alias("verdict"),
                      F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.col("branch"), F.round("purity", 9).alias("purity"))


def op6(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
