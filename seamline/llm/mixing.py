"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Leaves are the (domain, lang, source) groups of a corpus. A token budget goes down the tree by the nodes' weights. What a node
can't supply (its tokens times the epochs allowed) is first shared out among its siblings by their weights; only what all of
them can't supply goes to the parent's siblings. Each leaf then gives its documents in a seeded order, one fresh order an
epoch, up to its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.session import Scratch, cut

LEVELS = ("domain", "lang", "source")
#: Rows of an order bucket on average: prefix sums run in buckets of the order, so that no leaf is ordered in one task.
BUCKET_ROWS = 4096
#: Leaves are broadcast up to this many (a row is under 200 bytes); more are joined by a shuffle.
MAX_BROADCAST_LEAVES = 20_000


def tokens(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def tie(text: Column) -> Column:
    """Orders the texts of one doc_id: half of an MD5, as hex."""
    return F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 16)


def place(seed: int, epoch: Column, doc_id: Column, tie: Column) -> Column:
    """Seeded place of a document in an epoch's order, 0 to 2**32 - 1; that of a null doc_id goes by its text."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), tie))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def _fill(nodes: DataFrame, parent: list[str], key: list[str]) -> DataFrame:
    """``share`` of each node (weight, capacity) in its parent's ``budget``: min(capacity, level * weight), one level for all siblings.

    Siblings in order of capacity / weight fill up one after another; the first that the level of the rest doesn't fill ends it
    (levels fall from there on, so it is the largest among such).
    Whole numbers in, whole numbers out. Runs over nodes of the tree, not over documents.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = [F.col("capacity") / F.col("weight"), *[F.col(k).asc_nulls_first() for k in key]]
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = w.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(rest)
    nodes = nodes.withColumn("_level", level)
    nodes = nodes.withColumn("_open", F.col("capacity") > F.col("_level") * F.col("weight"))
    first = F.max(F.when(F.col("_open"), F.col("_level"))).over(w)
    return nodes.withColumn("share", F.when(first.isNull(), F.col("capacity")).otherwise(F.least("capacity", F.floor(first * F.col("weight"))))).drop("_level", "_open")


def budgets(leaves: DataFrame, total: int, weights: dict[str, Column], max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, n_docs, n_tokens) with ``share``: the tokens each is to give.

    ``weights`` gives a whole positive weight Column for each level, over that level's key columns.
    """
    out = leaves.withColumn("capacity", F.col("n_tokens") * F.lit(max_epochs)).withColumn("share", F.lit(total).cast("long"))
    for depth, level in enumerate(LEVELS, 1):
        parent, key = list(LEVELS[: depth - 1]), list(LEVELS[:depth])
        node = out.groupBy(*key).agg(F.sum("capacity").alias("capacity"), F.first("share").alias("budget"))
        node = _fill(node.withColumn("weight", weights[level].cast("long")), parent, key).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("share").alias("_share"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        out = out.join(node, cond).drop("share", *[f"_{k}" for k in key]).withColumnRenamed("_share", "share")
    return out


def _join_leaves(rows: DataFrame, leaves: DataFrame, on: tuple[str, ...] = ("leaf",)) -> DataFrame:
    """``rows`` with the columns of their leaf (by ``leaf``, a number); broadcast only if there are few leaves."""
    few = leaves.limit(MAX_BROADCAST_LEAVES + 1).count() <= MAX_BROADCAST_LEAVES
    return rows.join(F.broadcast(leaves) if few else leaves, list(on))


def plan(docs: DataFrame, domain: Column, weights: dict[str, Column], budget: float, max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: its key columns, n_docs, n_tokens, share, full (whole epochs), and where its last epoch ends.

    The last epoch takes documents in order while their first token lies within the rest of the share: ``last_place``,
    ``last_id`` and ``last_tie`` name the final one, ``last_start`` its first token's position, ``last_rows`` how many rows are
    equal to it. Prefix sums are taken over order buckets
    first, then inside the one bucket of each leaf in which its share ends, so no leaf is sorted in one task. Texts are read once.
    """
    rows = docs.select(F.col("doc_id").cast("long"), domain.alias("domain"), F.col("lang").cast("string"), F.col("source").cast("string"), tokens(F.col("text").cast("string")).alias("tokens"), tie(F.col("text").cast("string")).alias("tie"))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(rows.withColumn("leaf", F.xxhash64(*LEVELS)))
    leaves = rows.groupBy("leaf", *LEVELS).agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    leaves = cut(leaves)
    total = int(budget * (leaves.agg(F.sum("n_tokens")).first()[0] or 0))
    shared = budgets(leaves, total, weights, max_epochs)
    shared = shared.withColumn("full", F.coalesce(F.floor(F.try_divide(F.col("share"), F.col("n_tokens"))), F.lit(0)).cast("long"))
    shared = cut(shared.withColumn("rest", F.col("share") - F.col("full") * F.col("n_tokens")).withColumn("n_buckets", F.ceil(F.col("n_docs") / BUCKET_ROWS).cast("long")))
    part = _join_leaves(rows.select("leaf", "doc_id", "tokens", "tie"), shared.where("rest > 0").select("leaf", "full", "rest", "n_buckets"))
    part = part.withColumn("place", place(seed, F.col("full"), F.col("doc_id"), F.col("tie")))
    part = part.withColumn("bucket", F.floor(F.col("place") * F.col("n_buckets") / F.lit(1 << 32)).cast("long"))
    sums = part.groupBy("leaf", "bucket").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    w = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).where("start < rest and start + n >= rest").select("leaf", "bucket", "start")
    inside = _join_leaves(part, scratch.keep(ends), on=("leaf", "bucket"))  # a row a leaf, read back so that its leaf's dealing isn't taken over
    inside = inside.groupBy("leaf", "place", "doc_id", "tie").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    v = Window.partitionBy("leaf").orderBy("place", F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("start") + F.coalesce(F.sum("tokens").over(v), F.lit(0))).where("at < rest")
    last = inside.groupBy(F.col("leaf").alias("l")).agg(F.max(F.struct("place", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "tie", "at", "n_rows")).alias("m"))
    last = last.select("l", F.col("m.place").alias("last_place"), F.col("m.id").alias("last_id"), F.col("m.tie").alias("last_tie"), F.col("m.at").alias("last_start"), F.col("m.n_rows").alias("last_rows"))
    return cut(shared.join(last, F.col("leaf") == F.col("l"), "left").drop("l"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, Column], budget: float = 1.0, max_epochs: int = 2, seed: int = 1) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, ...) as mixed: a row for each epoch that takes a document, with epoch and n_taken.

    ``domain`` maps a row to the tree's first level, ``weights`` a level to whole positive weights, ``budget`` is the share
    of the corpus' tokens to give out. n_taken is the document's tokens, fewer where its leaf's budget ends inside it. Null
    lang or source make leaves of their own; texts without tokens are taken with epochs that are taken whole. Rows of
    one doc_id and leaf are ordered by a hash of the text; rows equal in that too stand at one place, and where the budget
    ends there they share what is left evenly, in whole tokens. A null doc_id has its place by its text.
    Texts are only read where they are: leaves, not documents, are shuffled and joined. Columns named epoch or n_taken are an error.
    """
    if clash := {"epoch", "n_taken"} & set(docs.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    leaves = plan(docs, domain, weights, budget, max_epochs, seed)
    rows = docs.withColumn("_tokens", tokens(F.col("text").cast("string"))).withColumn("leaf", F.xxhash64(domain, F.col("lang").cast("string"), F.col("source").cast("string")))
    got = _join_leaves(rows, leaves.select("leaf", F.col("full").alias("_full"), F.col("rest").alias("_rest"), "last_place", "last_id", "last_tie", "last_start", "last_rows"))
    got = got.withColumn("_tie", tie(F.col("text").cast("string")))
    spot = place(seed, F.col("_full"), F.col("doc_id"), F.col("_tie"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    got = got.withColumn("_spot", spot)
    here, end = F.struct(F.col("_spot").alias("last_place"), number.alias("last_id"), F.col("_tie").alias("last_tie")), F.struct("last_place", "last_id", "last_tie")
    got = got.withColumn("_is_last", here == end)
    takes = (F.col("_rest") > 0) & F.col("last_place").isNotNull() & (here <= end)
    whole = F.when(F.col("_full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1), lambda e: F.struct(e.alias("epoch"), F.col("_tokens").alias("n_taken"))))
    some = F.when(takes, F.array(F.struct(F.col("_full").alias("epoch"), F.when(F.col("_is_last"), F.least(F.col("_tokens"), F.floor((F.col("_rest") - F.col("last_start")) / F.col("last_rows")))).otherwise(F.col("_tokens")).alias("n_taken"))))
    none = F.array().cast("array<struct<epoch:bigint,n_taken:bigint>>")
    got = got.withColumn("_t", F.explode(F.concat(F.coalesce(whole, none), F.coalesce(some, none))))
    return got.select(*[F.col(c) for c in docs.columns], F.col("_t.epoch").alias("epoch"), F.col("_t.n_taken").alias("n_taken"))


# The mixture of the queries: fixed values.
def corpus_domain() -> Column:
    """src0 is the web crawl, src1 to src9 reference works, the others (and unknown sources) community text."""
    return F.when(F.col("source") == "src0", "web").when(F.col("source").rlike("^src[1-9]$"), "reference").otherwise("community")


def corpus_weights() -> dict[str, Column]:
    return {
        "domain": F.when(F.col("domain") == "web", 4).when(F.col("domain") == "reference", 3).otherwise(3),
        "lang": F.when(F.col("lang") == "en", 5).when(F.col("lang").isin("de", "fr"), 2).otherwise(1),
        "source": F.lit(1),
    }


def op2_rows(docs: DataFrame) -> DataFrame:
    return mix(docs, corpus_domain(), corpus_weights()).select("doc_id", "lang", "source", "epoch", "n_taken")


_LEVEL_SQL = """
{level}_node AS (SELECT {key}, sum(capacity) AS capacity, any_value({parent_share}) AS budget FROM {source} GROUP BY {key}),
{level}_w AS (SELECT *, {weight} AS weight FROM {level}_node),
{level}_l AS (SELECT *, CAST(budget - coalesce(sum(capacity) OVER ({part} ORDER BY CAST(capacity AS DOUBLE) / weight, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(weight) OVER ({part} ORDER BY CAST(capacity AS DOUBLE) / weight, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM {level}_w),
{level}_m AS (SELECT *, max(CASE WHEN capacity > level * weight THEN level END) OVER ({part0}) AS first FROM {level}_l),
{level}_s AS (SELECT {key}, CASE WHEN first IS NULL THEN capacity ELSE least(capacity, CAST(floor(first * weight) AS BIGINT)) END AS share_{level} FROM {level}_m),
{level}_t AS (SELECT t.*, s.share_{level} FROM {source} t JOIN {level}_s s ON {same})"""


def oracle() -> str:
    """op2_rows in DuckDB SQL; the whole order of every leaf in one window."""
    weight = {"domain": "CASE domain WHEN 'web' THEN 4 ELSE 3 END", "lang": "CASE WHEN lang = 'en' THEN 5 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END", "source": "1"}
    parts, source, share = [], "leaves", "total"
    for i, level in enumerate(LEVELS, 1):
        key = ", ".join(LEVELS[:i])
        parent = ", ".join(LEVELS[: i - 1])
        parts.append(_LEVEL_SQL.format(level=level, key=key, parent_share=share, source=source, weight=weight[level], part=f"PARTITION BY {parent}" if parent else "", part0=f"PARTITION BY {parent}" if parent else "", order=", ".join(f"{k} NULLS FIRST" for k in LEVELS[:i]), same=" AND ".join(f"t.{k} IS NOT DISTINCT FROM s.{k}" for k in LEVELS[:i])))
        source, share = f"{level}_t", f"share_{level}"
    return f"""
WITH docs AS (SELECT doc_id, lang, source, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[1-9]$') THEN 'reference' ELSE 'community' END AS domain,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens, substr(md5(coalesce(text, '')), 1, 16) AS tie FROM documents),
sized AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM docs GROUP BY ALL),
leaves AS (SELECT *, 2 * n_tokens AS capacity, (SELECT CAST(sum(n_tokens) AS BIGINT) FROM sized) AS total FROM sized),
{",".join(parts)},
parts AS (SELECT *, CASE WHEN n_tokens = 0 THEN 0 ELSE share_source // n_tokens END AS full_epochs FROM source_t),
rows_ AS (SELECT d.*, p.full_epochs, p.share_source - p.full_epochs * p.n_tokens AS rest,
  CAST(('0x' || substr(md5('1:' || p.full_epochs || ':' || coalesce(CAST(d.doc_id AS VARCHAR), d.tie)), 1, 8)) AS BIGINT) AS place
  FROM docs d JOIN parts p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
equal_rows AS (SELECT domain, lang, source, place, doc_id, tie, sum(tokens) AS n, count(*) AS n_rows FROM rows_ GROUP BY ALL),
begun AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id NULLS FIRST, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM equal_rows),
ordered AS (SELECT r.*, b.begins, b.n_rows FROM rows_ r JOIN begun b ON r.domain = b.domain AND r.lang IS NOT DISTINCT FROM b.lang AND r.source IS NOT DISTINCT FROM b.source
  AND r.place = b.place AND r.doc_id IS NOT DISTINCT FROM b.doc_id AND r.tie = b.tie)
SELECT doc_id, lang, source, CAST(e.epoch AS BIGINT) AS epoch, tokens AS n_taken FROM rows_, (SELECT unnest(range(0, 2)) AS epoch) e WHERE e.epoch < full_epochs
UNION ALL
SELECT doc_id, lang, source, CAST(full_epochs AS BIGINT), CAST(least(tokens, (rest - begins) // n_rows) AS BIGINT) FROM ordered WHERE rest > 0 AND begins < rest"""
