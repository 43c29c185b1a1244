"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, lang, source). A token budget runs down the tree by weights. Where a
node's supply falls short of its share, its siblings take the shortage over in proportion to
their weights; only what a whole subtree lacks reaches the siblings of its parent. Every
leaf then takes whole epochs and a prefix of one more, in an order seeded for that epoch.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"
TREE = ("domain", "lang", "source")
#: A leaf's epoch is cut in so many hash ranges, the one that holds the cut again, and so on; the last is put in order.
RANGES = 256
#: Ranges are cut until the largest leaf has about so many rows in one.
ORDERED = 1024
#: 15 hexadecimal digits of the order hash.
KEY_SPAN = 16**15


def n_tokens(text: Column) -> Column:
    """Tokens of a text: its words; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(seed: int, epoch: Column, row_id: Column) -> Column:
    """The place of a row in an epoch's order, a number of 60 bits."""
    named = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(row_id.cast("string"), F.lit("-")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("bigint")


def weight_of(name: str, weights: Mapping[str, float], default: float) -> Column:
    out = None
    for k, v in sorted(weights.items()):
        out = F.when(F.col(name) == k, float(v)) if out is None else out.when(F.col(name) == k, float(v))
    return F.lit(float(default)) if out is None else out.otherwise(float(default))


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Add ``budget`` to children with ``weight``, ``supply`` and their parent's ``given``.

    In the order of supply per weight, a child that lacks its share of what is left gets its
    supply; all after it share the rest by weight.
    """
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(*parent).orderBy("ratio", child)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    left = F.greatest(F.col("given") - F.coalesce(F.sum("supply").over(before), F.lit(0.0)), F.lit(0.0))
    rated = children.withColumn("ratio", ratio).withColumns({"left": left, "rest": F.sum("weight").over(after)})
    rated = rated.withColumn("level", F.when(F.col("rest") > 0, F.col("left") / F.col("rest")).otherwise(0.0))
    rated = rated.withColumn("short", F.col("ratio") <= F.col("level"))
    level = F.max(F.when(~F.col("short"), F.struct(-F.col("ratio"), F.col("level")))).over(Window.partitionBy(*parent))["level"]
    return rated.withColumn("budget", F.when(F.col("short"), F.col("supply")).otherwise(F.least(F.col("supply"), F.col("weight") * level))).drop("ratio", "left", "rest", "level", "short")


def leaf_budgets(leaves: DataFrame, budget: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]], default_weight: float = 1.0) -> DataFrame:
    """Budgets in tokens for leaves (domain, lang, source, tokens of one epoch)."""
    node = leaves.withColumn("supply", (F.col("tokens") * max_epochs).cast("double"))
    given = None
    for depth in range(len(TREE)):
        own, parent = list(TREE[: depth + 1]), list(TREE[:depth])
        children = node.groupBy(*own).agg(F.sum("supply").alias("supply")).withColumn("weight", weight_of(TREE[depth], weights.get(TREE[depth], {}), default_weight))
        children = children.withColumn("given", F.lit(float(budget))) if given is None else children.join(given, parent)
        given = share_out(children, parent or [F.lit(0)], TREE[depth]).select(*own, F.col("budget").alias("given"))
    return leaves.join(given, list(TREE)).select(*TREE, "tokens", F.least(F.floor("given"), F.col("tokens") * max_epochs).cast("bigint").alias("budget"))


def select_epochs(meta: DataFrame, leaves: DataFrame, seed: int, most_rows: int) -> DataFrame:
    """Where each leaf's selection ends: (domain, lang, source, epochs, cut_key).

    A row is in epochs 0 to ``epochs`` - 1, and in the next if its order key is at most ``cut_key``.
    ``most_rows`` is the largest leaf's number of rows: each pass over the keys narrows the cut down
    to one of ``RANGES`` ranges, and there are as many passes as leave ``ORDERED`` rows to order.
    """
    tree = list(TREE)
    leaves = leaves.filter("tokens > 0").select(*tree, F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"), F.pmod("budget", "tokens").alias("rest"))
    keyed = meta.filter("tokens > 0").join(leaves, tree).select(*tree, "tokens", order_key(seed, F.col("epochs"), F.col("doc_id")).alias("key"))
    span, rows = KEY_SPAN, most_rows
    cuts = leaves.select(*tree, "rest", F.lit(0).cast("bigint").alias("range"), F.lit(0).cast("bigint").alias("before"))
    while rows > ORDERED and span > RANGES or span == KEY_SPAN:
        inside = keyed.join(cuts, tree).filter(F.floor(F.col("key") / F.lit(span)) == F.col("range"))
        span, rows = span // RANGES, rows / RANGES
        sums = inside.groupBy(*tree, "rest", "before", F.floor(F.col("key") / F.lit(span)).alias("range")).agg(F.sum("tokens").alias("n"))
        sums = sums.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*tree).orderBy("range")))
        cuts = materialise(sums.filter("upto > rest").groupBy(*tree, "rest").agg(F.min("range").alias("range"), F.min(F.col("upto") - F.col("n")).alias("before")))
    inside = keyed.join(cuts, tree).filter(F.floor(F.col("key") / F.lit(span)) == F.col("range"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*tree).orderBy("key")))
    last = inside.filter("upto <= rest").groupBy(*tree).agg(F.max("key").alias("last"))
    out = leaves.join(cuts.drop("rest"), tree, "left").join(last, tree, "left")
    return out.select(*tree, "epochs", F.coalesce(F.col("last"), F.col("range") * F.lit(span) - 1, F.lit(KEY_SPAN)).alias("cut_key"))


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, float]], fraction: float = 0.5, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """One row per document and epoch that the mixture takes: doc_id, domain, lang, source, tokens, epoch.

    ``fraction`` of all tokens is the budget; ``weights`` name domains, langs and sources, others
    weigh 1. Null domain, lang or source is the value ``-``. Texts without words, null ones too,
    are never taken. Rows of equal doc_id are taken or left together; an empty table gives none.
    """
    meta, cuts = plan_mixture(docs, domain, weights, fraction, max_epochs, seed)
    return take(meta, cuts, seed)


def labelled(docs: DataFrame, domain: Column) -> list[Column]:
    return [F.coalesce(c, F.lit("-")).alias(n) for n, c in (("domain", domain), ("lang", F.col("lang")), ("source", F.col("source")))]


def plan_mixture(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, float]], fraction: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    meta = materialise(docs.select("doc_id", *labelled(docs, domain), n_tokens(F.col("text")).alias("tokens")))
    leaves = materialise(meta.groupBy(*TREE).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    whole = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max("rows"), F.lit(0)).alias("rows")).first()
    budgets = materialise(leaf_budgets(leaves, fraction * whole["tokens"], max_epochs, weights))
    return meta, materialise(select_epochs(meta, budgets, seed, whole["rows"]))


def take(rows: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """Rows with doc_id, the tree's columns and tokens, once for each epoch that takes them."""
    key = order_key(seed, F.col("epochs"), F.col("doc_id"))
    n = F.col("epochs") + F.when(key <= F.col("cut_key"), 1).otherwise(0)
    return (
        rows.filter("tokens > 0").join(cuts, list(TREE))
        .withColumn("n", n).filter("n > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .drop("n", "epochs", "cut_key")
    )


def keep_mixture(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, float]], fraction: float, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all columns, that the mixture takes in one epoch; no shuffle of texts.

    Null domain, lang or source is the value ``-``, in the tree only. Texts without words, null and empty
    ones too, are never taken. Rows of equal doc_id in one leaf, null ids too, are taken or left together;
    an empty table gives none; further columns stay, whatever their names.
    """
    _, cuts = plan_mixture(docs, domain, weights, fraction, 1, seed)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", *labelled(docs, domain), n_tokens(F.col("text")).alias("tokens"))
    return take(rows, cuts, seed).select("row.*")
