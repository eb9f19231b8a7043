"""Mixing sources to target weights by hierarchical budgeting.

Documents hang under a tree domain > language > source. A token budget goes
down the tree: at every node it is shared among the children by weight, but no
child gets more than it can supply (its tokens times ``max_epochs``); what a
child can't use goes to its siblings by weight first, and only what no sibling
can use was never handed down, so it stays with the ancestors' other children.
(Closed form: children sorted by supply per weight; the saturated ones are a
prefix, the rest share what is left, rounded so that the parts add up exactly.)

A leaf's budget is filled by whole seeded epochs and a token-prefix of the next:
an epoch orders the leaf's documents by md5(seed, epoch, doc_id) and the last
document taken may be cut. Prefix sums run in two levels, over hash buckets of
about ``per_bucket`` documents and, only in the bucket where the budget ends,
over its documents; so a source with a third of all rows spreads like any other.

Built-in functions only. Edge cases: null lang or source is a name of its own
('none'), null or empty texts have no tokens and are never taken; names without
a given weight weigh ``default_weight``, weight 0 excludes a branch; ties in an
epoch's order go by text hash; rows that repeat a doc_id are taken each for
itself; an empty table or a zero budget gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelens.llm.store import stored

BLANKS = " \t\n\x0b\f\r"
TREE = ("domain", "lang", "source")


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def _share(nodes: DataFrame, level: int) -> DataFrame:
    """Split each parent's ``budget`` over the nodes of a level (column ``got``)."""
    parent, name = list(TREE[:level]), TREE[level]
    all_ = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = all_.orderBy(F.col("cap") / F.col("w"), name)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    n = nodes.filter("w > 0 AND cap > 0")
    n = n.withColumn("before", F.sum("cap").over(upto) - F.col("cap")).withColumn(
        "rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    n = n.withColumn("full", F.col("cap").cast("double") * F.col("rest")
                     <= F.col("w").cast("double") * (F.col("budget") - F.col("before")))
    open_w = F.when(F.col("full"), 0).otherwise(F.col("w"))
    n = n.withColumn("left", (F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_))
                     .cast("double"))
    n = n.withColumn("all_w", F.sum(open_w).over(all_)).withColumn("upto_w", F.sum(open_w).over(upto))
    part = lambda w: F.floor(F.col("left") * w / F.col("all_w"))
    got = F.when(F.col("full"), F.col("cap")).otherwise(part(F.col("upto_w")) - part(F.col("upto_w") - F.col("w")))
    return n.withColumn("got", got.cast("long"))


def leaf_budgets(leaves: DataFrame, weights: dict, budget: int, max_epochs: int, default_weight: int) -> DataFrame:
    """(domain, lang, source, tokens, n_docs, got) of every leaf with a budget."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)

    def weight(name):
        out = F.lit(default_weight)
        for k, v in sorted(weights.get(name, {}).items()):
            out = F.when(F.col(name) == k, v).otherwise(out)
        return out.cast("long")
    # a branch with weight 0 supplies nothing, on whatever level it stands
    leaves = leaves.filter((weight("domain") > 0) & (weight("lang") > 0) & (weight("source") > 0))
    given = None
    for level, name in enumerate(TREE):
        keys = list(TREE[:level + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").cast("long").alias("cap")).withColumn("w", weight(name))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if given is None else nodes.join(
            given, list(TREE[:level]))
        given = _share(nodes, level).select(*keys, F.col("got").alias("budget"))
    return leaves.join(given.withColumnRenamed("budget", "got"), list(TREE)).filter("got > 0")


def mix_sources(docs: DataFrame, domain: Column, weights: dict, budget_share: float = 0.5, max_epochs: int = 2,
                seed: int = 20, default_weight: int = 100, per_bucket: int = 2000, tag: str | None = None) -> DataFrame:
    """(doc_id, epoch, domain, lang, source, n_tokens, taken, th): the documents
    of the mix with the tokens taken of each; the budget is a share of all
    tokens. ``weights`` maps a level's name to whole weights by node name. With
    ``tag``, a column of ``docs`` that differs in every row, it is returned too."""
    tags = [tag] if tag else []
    meta = docs.select("doc_id", *tags, F.xxhash64("text").alias("th"),
                       *[F.coalesce(c, F.lit("none")).alias(n) for c, n in
                         ((domain, "domain"), (F.col("lang").cast("string"), "lang"),
                          (F.col("source").cast("string"), "source"))],
                       n_words(F.col("text").cast("string")).alias("n_tokens"))
    meta = stored(meta.filter("n_tokens > 0"))
    total = meta.agg(F.sum("n_tokens")).first()[0] or 0
    leaves = meta.groupBy(*TREE).agg(F.sum("n_tokens").cast("long").alias("tokens"),
                                     F.count(F.lit(1)).alias("n_docs"))
    # one row per leaf; stored, as every reader would run the windows of all levels again
    plan = stored(leaf_budgets(leaves, weights, int(total * budget_share), max_epochs, default_weight))
    epochs = (plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
              .withColumn("quota", F.least(F.col("tokens"), F.col("got") - F.col("epoch") * F.col("tokens")))
              .filter("quota > 0")
              .withColumn("buckets", F.ceil(F.col("n_docs") / per_bucket).cast("long"))
              .select(*TREE, "epoch", "quota", "buckets"))
    rows = meta.join(epochs, list(TREE)).withColumn("place", F.md5(F.concat_ws(
        ":", F.lit(seed).cast("string"), F.col("epoch").cast("string"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    # the bucket follows the order of md5: its first 8 digits as a share of the whole range
    rows = rows.withColumn("bucket", F.floor(
        F.conv(F.substring("place", 1, 8), 16, 10).cast("long") / F.lit(4294967296.0) * F.col("buckets")).cast("long"))
    cell = [*TREE, "epoch", "bucket"]
    sums = rows.groupBy(*cell, "quota").agg(F.sum("n_tokens").alias("sum"))
    w = Window.partitionBy(*TREE, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = (sums.withColumn("start", F.sum("sum").over(w) - F.col("sum")).filter("start < quota")
            .withColumn("room", F.col("quota") - F.col("start")).select(*cell, "sum", "room"))
    hit = rows.drop("quota").join(sums, cell)
    out = ["doc_id", "epoch", *TREE, "n_tokens", "taken", "th", *tags]
    whole = hit.filter("sum <= room").withColumn("taken", F.col("n_tokens")).select(*out)
    inside = Window.partitionBy(*cell).orderBy("place", "th", *tags).rowsBetween(Window.unboundedPreceding, 0)
    edge = (hit.filter("sum > room").withColumn("start", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
            .filter("start < room").withColumn("taken", F.least(F.col("n_tokens"), F.col("room") - F.col("start")))
            .select(*out))
    return whole.unionByName(edge)


def mixed_documents(docs: DataFrame, domain: Column, weights: dict, **options) -> DataFrame:
    """The mix with its texts: all columns of ``docs`` and domain, epoch, n_tokens,
    taken (which take the place of columns of these names); a document that is taken
    in part keeps its first ``taken`` words. Rows are numbered in a stored copy first, so that
    equal rows are taken as often as the mix takes them."""
    own = ("domain", "epoch", "n_tokens", "taken")
    names = [c for c in docs.columns if c not in own]
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    mix = mix_sources(numbered, domain, weights, tag="__row", **options).select(
        F.col("__row").alias("__taken_row"), *[F.col(c).alias(f"__mix_{c}") for c in own])
    words = F.split(F.btrim("text", F.lit(BLANKS)), "[ \\t-\\r]+")
    cut = F.when(F.col("__mix_taken") < F.col("__mix_n_tokens"),
                 F.array_join(F.slice(words, F.lit(1), F.col("__mix_taken").cast("int")), " ")).otherwise(F.col("text"))
    return (numbered.join(mix, F.col("__row") == F.col("__taken_row"))
            .select(*[cut.alias(c) if c == "text" else F.col(c) for c in names],
                    *[F.col(f"__mix_{c}").alias(c) for c in own]))
