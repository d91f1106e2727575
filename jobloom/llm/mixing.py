"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of domains, languages and sources. At each node it is shared among the
children by weight, and a child never gets more than it can supply (its tokens times the epochs allowed);
what a short child can't take goes to its siblings by weight. As a node's limit is what all its leaves
together can supply, a shortage reaches other branches only when no sibling can absorb it.

Each leaf reads whole epochs of its documents and then the longest prefix, in the seeded order of the next
epoch, that fits the rest of its budget. The prefix is found without sorting a leaf: hash buckets are
summed, the bucket at the cut is cut into buckets again, and only documents of the last one, one in 256 to
the power of ``_ROUNDS``, are ranked. Texts are read twice, once to count words and once for the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import Scratch

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order hash that name a bucket in each round: 256 buckets a leaf, then 256 of one of these.
_DIGITS, _ROUNDS = 2, 3


def token_count(text: Column) -> Column:
    """Words of other than white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), 0)), F.lit(0)).cast("long")


def weight_of(name: Column, weights: dict[str, int]) -> Column:
    """A named child's weight; 1 for others."""
    out = F.lit(1)
    for key, weight in weights.items():
        out = F.when(name == key, weight).otherwise(out)
    return out.cast("long")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given``: each parent's ``budget`` shared by ``weight`` under the limits ``cap``, whole tokens."""
    wide = "decimal(38,0)"
    siblings = Window.partitionBy(*parent)
    order = siblings.orderBy(F.col("cap") / F.nullif("weight", F.lit(0)), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("cap").cast(wide) * rest.cast("decimal(18,0)") <= (F.col("budget") - before).cast(wide) * F.col("weight").cast("decimal(18,0)")
    out = children.withColumn("full", full)
    filled = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(siblings)
    out = out.withColumn("left", F.col("budget") - filled).withColumn("open", open_)
    part = F.expr("cast(cast(left as decimal(20,0)) * cast(weight as decimal(18,0)) div nullif(open, 0) as long)")
    return out.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(part, F.lit(0)))).drop("full", "left", "open")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int | Column, epochs: int) -> DataFrame:
    """(domain, lang, source, supply, given) from (domain, lang, source, supply); ``budget`` is of tokens.

    A column as ``budget`` is taken of the total supply, named ``supply``.
    """
    leaves = leaves.withColumn("cap", F.col("supply") * epochs)
    root = leaves.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("supply"), F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"))
    whole = F.lit(budget) if isinstance(budget, int) else budget
    state = root.select(F.least(whole.cast("long"), "cap").alias("budget"))
    known: list[str] = []
    for level in LEVELS:
        nodes = leaves.groupBy(*known, level).agg(F.sum("cap").alias("cap")).withColumn("weight", F.greatest(weight_of(F.col(level), weights.get(level, {})), F.lit(0)))
        nodes = nodes.join(state, known) if known else nodes.withColumn("_all", F.lit(1)).join(state.withColumn("_all", F.lit(1)), "_all")
        state = share(nodes, known or ["_all"], level)
        known.append(level)
        state = state.select(*known, F.col("given").alias("budget"))
    return leaves.join(state, known).select(*known, "supply", F.col("budget").alias("given"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: int | Column, epochs: int = 2, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` plus ``domain``, ``n_tokens`` and ``epoch``, a row for each time a document is read.

    ``weights`` holds, by level, weights of named domains, languages and sources; others weigh 1, and a
    weight of 0 gives nothing. ``domain`` is an expression on ``docs``. A null domain, language or source is
    a child named ``(none)``. A null or empty text has no tokens; such documents are read with the bucket
    they fall in, but a leaf without any token is not read. Repeated rows are documents of their own; rows
    of one id and text are read together. A text counts whole however long it is. Columns of ``docs`` named
    like the new ones are replaced. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    new = ("domain", "n_tokens", "epoch")
    others = [c for c in docs.columns if c not in new]
    leaf = [F.coalesce(c.cast("string"), F.lit("(none)")).alias(n) for c, n in zip((domain, F.col("lang"), F.col("source")), LEVELS, strict=True)]
    text = F.col("text").cast("string")
    order = ("own", "n_tokens", "mark")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), *leaf, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("own"), token_count(text).alias("n_tokens"), F.xxhash64(text).alias("mark"))
    slim = scratch.keep(rows.select(*LEVELS, *order), "lengths")
    plan = budgets(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), weights, budget, epochs).where("supply > 0")
    plan = scratch.keep(plan.select(*LEVELS, F.expr("given div supply").alias("full"), F.expr("given % supply").alias("rest_tokens")), "plan")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), "own")).alias("key")

    inside, cut = slim.join(plan, list(LEVELS)).select(*LEVELS, key, *order), plan.withColumn("below", F.lit(0).cast("long"))
    for digits in range(_DIGITS, _DIGITS * _ROUNDS + 1, _DIGITS):
        sums = inside.groupBy(*LEVELS, F.substring("key", 1, digits).alias("cut")).agg(F.sum("n_tokens").alias("inside"))
        upto = F.col("below") + F.sum("inside").over(Window.partitionBy(*LEVELS).orderBy("cut"))
        found = sums.join(cut.select(*LEVELS, "full", "rest_tokens", "below"), list(LEVELS)).withColumn("upto", upto).where("upto > rest_tokens")
        found = found.groupBy(*LEVELS, "full", "rest_tokens").agg(F.min(F.struct("cut", (F.col("upto") - F.col("inside")).alias("below"))).alias("c"))
        cut = scratch.keep(found.select(*LEVELS, "full", "rest_tokens", "c.cut", "c.below"), "cuts")
        kept = inside.join(cut.select(*LEVELS, "cut"), list(LEVELS)).where(F.substring("key", 1, digits) == F.col("cut")).drop("cut")
        inside = scratch.keep(kept, "inside")
    scratch.forget(slim)
    before = Window.partitionBy(*LEVELS).orderBy("key", *order).rowsBetween(Window.unboundedPreceding, 0)
    edge = inside.groupBy(*LEVELS, "key", *order).agg(F.sum("n_tokens").alias("tokens")).join(cut.select(*LEVELS, "rest_tokens", "below"), list(LEVELS))
    edge = edge.withColumn("upto", F.col("below") + F.sum("tokens").over(before)).where("upto <= rest_tokens")
    last = edge.groupBy(*LEVELS).agg(F.max(F.struct("key", *order)).alias("last"))
    bounds = scratch.keep(cut.select(*LEVELS, "full", "cut").join(last, list(LEVELS), "left"), "bounds")

    placed = rows.join(bounds, list(LEVELS)).withColumn("key", key)
    taken = (F.col("key") < F.col("cut")) | F.coalesce(F.struct("key", *order) <= F.col("last"), F.lit(False))
    read = placed.withColumn("times", F.col("full") + taken.cast("long")).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    columns = [*[F.col(f"rest.`{c}`").alias(c) for c in others if c not in LEVELS], *[F.col(c) if c == "domain" else F.col(f"rest.`{c}`") for c in LEVELS if c == "domain" or c in others], "n_tokens", "epoch"]
    return read.select(*columns)
