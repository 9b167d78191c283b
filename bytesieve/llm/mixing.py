"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of domain, language and source. At each node the children share the node's
budget by weight; what a child cannot fill goes to its siblings first, and only a subtree that is short as a
whole leaves tokens to the siblings of its parent. Each leaf then gives whole seeded epochs and a
prefix of one more, in an order drawn from the seed, the epoch and the document's id.

All sums are integers, so every run and every engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytesieve.session import lookup_join, materialize

# Hex digits of the order key that name a bucket; a leaf's prefix ends in one bucket, whose rows are sorted.
BUCKET_DIGITS = 3
# A word, counted as one token.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def share_out(children: DataFrame, parent: list[str], child: str, budget: Column) -> DataFrame:
    """Add ``quota`` to ``children`` (parent columns, child, weight, capacity; ``budget`` per parent).

    Children are taken in the order of capacity per weight. One is full while its capacity is within its share of
    what the full ones before it leave; the others divide the rest by weight, rounded down.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(child)]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    left = budget - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    full = F.col("capacity") * F.sum("weight").over(onward) <= F.col("weight") * left
    rest = budget - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(whole), F.lit(0))
    weights = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole)
    part = F.col("_weighted") - F.pmod(F.col("_weighted"), F.col("_weights"))
    return (
        children.withColumn("_full", full)
        .withColumns({"_rest": rest, "_weights": weights})
        .withColumn("_weighted", F.col("weight") * F.col("_rest"))
        .withColumn(
            "quota", F.when(F.col("_full"), F.col("capacity")).otherwise((part / F.col("_weights")).cast("long"))
        )
        .drop("_full", "_rest", "_weights", "_weighted")
    )


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The document's place in a leaf's epoch: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def leaf_quotas(leaves: DataFrame, weights: dict[str, Column], budget: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, quota) for leaves (domain, lang, source, tokens).

    ``weights`` has an integer expression over the node's columns for each level; a weight below 1 counts
    as 1. The window over all domains holds one row per domain, the others one row per child of a node.
    """
    path = ["domain", "lang", "source"]

    def weighted(frame: DataFrame, level: str) -> DataFrame:
        return frame.withColumn("weight", F.greatest(weights.get(level, F.lit(1)).cast("long"), F.lit(1)))

    capacity = F.sum(F.col("tokens") * max_epochs).cast("long").alias("capacity")
    quotas = None
    for depth, level in enumerate(path):
        parent = path[:depth]
        nodes = weighted(leaves.groupBy(*path[: depth + 1]).agg(capacity), level)
        if quotas is None:
            nodes = nodes.withColumn("budget", F.least(F.lit(budget), F.sum("capacity").over(Window.partitionBy())))
        else:
            nodes = nodes.join(quotas.withColumnRenamed("quota", "budget"), parent)
        quotas = share_out(nodes, parent, level, F.col("budget")).select(*parent, level, "quota")
    return leaves.join(quotas, path)


def mix(
    documents: DataFrame,
    *,
    domain: Column,
    weights: dict[str, Column],
    budget_share: float = 1.0,
    max_epochs: int = 2,
    seed: int = 1,
    tokens: Column | None = None,
) -> DataFrame:
    """The documents chosen: ``doc``, a struct of all their columns, and ``mix`` (domain, tokens, quota, epoch, key).

    ``budget_share`` is the budget as a share of all tokens, ``tokens`` the token count of a row (words by
    default). A document of a leaf that gives several epochs appears once per epoch. A document is in the
    last, partial epoch if the leaf's running tokens in key order, its own included, stay within what is left.
    Null lang or source is the empty string, null or empty texts have no tokens: they come with the prefix they fall in,
    and a leaf without any token gives none. Rows with equal ids in a leaf share one key and come or stay together, as do
    all rows without id. An empty table gives no rows.
    """
    path = ["domain", "lang", "source"]
    names = {
        "domain": F.coalesce(domain.cast("string"), F.lit("")),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
    }
    count = word_count(F.col("text")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    leaf = F.struct(*(column.alias(name) for name, column in names.items()))
    narrow = materialize(
        documents.select("doc_id", *(column.alias(name) for name, column in names.items()), count.alias("tokens")),
        "mix-tokens",
    )
    leaves = materialize(
        narrow.groupBy(*path).agg(F.sum("tokens").cast("long").alias("tokens")).where("tokens > 0"), "mix-leaves"
    )
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    quotas = materialize(
        leaf_quotas(leaves, weights, int(total * budget_share), max_epochs).select(
            *path,
            "quota",
            F.expr("quota div tokens").alias("epochs"),
            F.expr("quota % tokens").alias("rest"),
        ),
        "mix-quotas",
    )

    keyed = (
        lookup_join(narrow, quotas, path, "inner", spread_by=F.col("doc_id"))
        .select(*path, "epochs", "rest", "tokens", order_key(seed, F.col("epochs"), F.col("doc_id")).alias("key"))
        .where("rest > 0")
        .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    )
    buckets = keyed.groupBy(*path, "rest", "bucket").agg(F.sum("tokens").cast("long").alias("sum"))
    by_bucket = Window.partitionBy(*path).orderBy("bucket")
    # The bucket in which the rest runs out: rows of earlier buckets all belong to the prefix.
    ending = materialize(
        buckets.withColumn("upto", F.sum("sum").over(by_bucket))
        .where("upto > rest AND upto - sum <= rest")
        .groupBy(*path)
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("sum")).alias("before"))).alias("end")),
        "mix-ends",
    )
    within = lookup_join(keyed, ending, path, "inner", spread_by=F.col("key")).where("bucket = end.bucket")
    by_key = within.groupBy(*path, "rest", "end", "key").agg(F.sum("tokens").cast("long").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*path).orderBy("key")) + F.col("end.before")
    last = (
        by_key.withColumn("upto", upto)
        .groupBy(*path, "end")
        .agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("key"))).alias("key"))
        # Without such a key the prefix ends before the bucket: its name is below every key in it.
        .select(*path, F.coalesce("key", "end.bucket").alias("last_key"))
    )
    chosen = materialize(
        quotas.join(last, path, "left")
        .where("quota > 0")
        # No ending bucket: the rest is not used up by the leaf's documents or there is none.
        .select(
            F.struct(*path).alias("_leaf"), "quota", "epochs",
            F.when(F.col("rest") == 0, F.lit("")).otherwise(F.coalesce("last_key", F.lit("g"))).alias("last_key"),
        ),
        "mix-chosen",
    )
    rows = documents.select(F.struct("*").alias("doc"), leaf.alias("_leaf"), count.alias("_tokens"))
    joined = lookup_join(rows, chosen, ["_leaf"], "inner", spread_by=F.col("doc.doc_id"))
    partial = order_key(seed, F.col("epochs"), F.col("doc.doc_id")) <= F.col("last_key")
    copies = F.col("epochs") + partial.cast("long")
    epoch = F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)))
    return joined.select("doc", "_leaf", "_tokens", "quota", epoch.alias("_epoch")).select(
        "doc",
        F.struct(
            F.col("_leaf.domain").alias("domain"),
            F.col("_tokens").alias("tokens"),
            F.col("quota").alias("quota"),
            F.col("_epoch").alias("epoch"),
            order_key(seed, F.col("_epoch"), F.col("doc.doc_id")).alias("key"),
        ).alias("mix"),
    )
