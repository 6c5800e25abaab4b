"""Mixing sources to target weights: budgets handed down a domain-language-source tree, prefixes of seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

LEVELS = ("domain", "language", "origin")
NONE = "(none)"  # branch of null values
BUCKET_ROWS = 1000  # documents per bucket of an epoch's order, on average

DOMAINS = 4
# target weights per level; branches not named weigh 1
WEIGHTS = {
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0},
    "language": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    "origin": {},
}


def domain_of(source: Column, domains: int = DOMAINS) -> Column:
    """A fixed assignment of sources to domains, as the tables name none."""
    return F.concat(F.lit("d"), F.crc32(source.cast("binary")) % domains)


def poured(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` with budget: the parent's ``total`` dealt to its children by weight, none above its capacity.

    What a full child cannot take goes to its siblings by their weights. A child is full at the water level where
    the capacities of those that fill earlier and the weights of the rest use up the total, so one order by
    capacity per weight and running sums give the level. Columns: weight, capacity, total.
    """
    open_nodes = (F.col("weight") > 0) & (F.col("capacity") > 0)
    weight, capacity = F.when(open_nodes, F.col("weight")).otherwise(0.0), F.when(open_nodes, F.col("capacity")).otherwise(0)
    ratio = F.when(open_nodes, F.col("capacity") / F.col("weight")).otherwise(0.0)
    order = Window.partitionBy(*parent).orderBy(ratio, name)
    whole = Window.partitionBy(*parent)
    earlier = F.coalesce(F.sum(capacity).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum(weight).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    marked = nodes.withColumn("_full", ~open_nodes | (earlier + ratio * later <= F.col("total")))
    left = F.col("total") - F.sum(F.when(F.col("_full"), capacity).otherwise(0)).over(whole)
    shared = F.sum(F.when(F.col("_full"), 0.0).otherwise(weight)).over(whole)
    part = F.floor(left * weight / shared + 1e-9).cast("long")
    return marked.withColumn("budget", F.when(F.col("_full"), capacity).otherwise(F.least(part, capacity)).cast("long")
                             ).drop("_full")


def weight_of(level: str, weights: dict[str, dict[str, float]]) -> Column:
    named = weights.get(level, {})
    if not named:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1.0)).cast("double")


def leaf_budgets(leaves: DataFrame, share: float, epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """``leaves`` (domain, language, origin, tokens, docs) with budget.

    The root has ``share`` of all tokens; a leaf can give its tokens ``epochs`` times. An inner node's capacity is
    the sum of its leaves', so a shortage reaches an ancestor's siblings only when a whole subtree is full.
    """
    held = leaves.withColumn("capacity", F.when(
        (weight_of("domain", weights) > 0) & (weight_of("language", weights) > 0) & (weight_of("origin", weights) > 0),
        F.col("tokens") * epochs).otherwise(F.lit(0).cast("long")))
    total = F.floor(F.sum(F.sum("tokens")).over(Window.partitionBy(F.lit(0))) * share).cast("long")
    top = held.groupBy("domain").agg(F.sum("capacity").alias("capacity"), total.alias("total"))
    top = poured(top.withColumn("weight", weight_of("domain", weights)).withColumn("root", F.lit(0)), ["root"], "domain")
    middle = (held.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"))
              .join(top.select("domain", F.col("budget").alias("total")), "domain")
              .withColumn("weight", weight_of("language", weights)))
    middle = poured(middle, ["domain"], "language")
    bottom = (held.join(middle.select("domain", "language", F.col("budget").alias("total")), ["domain", "language"])
              .withColumn("weight", weight_of("origin", weights)))
    return poured(bottom, ["domain", "language"], "origin").select(*LEVELS, "tokens", "docs", "budget")


def mix(docs: DataFrame, share: float = 0.6, epochs: int = 2, weights: dict[str, dict[str, float]] | None = None,
        seed: int = 7, domain: Column | None = None) -> DataFrame:
    """The chosen rows of ``docs``, each with _epoch, _tokens and its leaf's domain, language, origin, budget.

    Tokens are words between white space. A leaf's budget is spent on whole epochs and then on the longest prefix
    of the next one that stays within it, documents ordered by a seeded hash of epoch and doc_id. The prefix ends
    in one bucket of that order; only the rows of this bucket, about ``BUCKET_ROWS``, are sorted, so a leaf with a
    third of all rows meets in no task. The leaf table then carries the cut, and texts are filtered where they
    lie. Null sources or languages are branches of their own; null texts have no tokens; rows that share a doc_id
    are taken or left together. An empty table gives an empty result.
    """
    weights = WEIGHTS if weights is None else weights
    named = [F.coalesce(domain if domain is not None else domain_of(F.col("source")), F.lit(NONE)).alias("_domain"),
             F.coalesce("lang", F.lit(NONE)).alias("_language"), F.coalesce("source", F.lit(NONE)).alias("_origin")]
    own = [F.col(f"`{c}`") for c in docs.columns]
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_tokens")
    keys = ["_domain", "_language", "_origin"]
    measured = materialize(docs.select(F.col("doc_id").alias("_id"), *named, tokens))
    leaves = measured.groupBy(*keys).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    budgets = leaf_budgets(leaves.toDF(*LEVELS, "tokens", "docs"), share, epochs, weights)
    spend = F.col("_budget")
    whole = F.when(F.col("_total") > 0, F.floor(spend / F.col("_total"))).otherwise(0).cast("int")
    plan = materialize(budgets.toDF(*keys, "_total", "_docs", "_budget").select(
        *keys, "_budget", whole.alias("_whole"), (spend - whole * F.col("_total")).alias("_rest"),
        F.greatest(F.ceil(F.log2(F.col("_docs") / BUCKET_ROWS)), F.lit(0)).cast("int").alias("_bits")))

    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_whole"), F.col("_id")), 1)
    bucket = F.expr("shiftright(_place, 63 - _bits)")
    placed = measured.join(plan, keys).where("_rest > 0").withColumn("_place", place).withColumn("_bucket", bucket)
    filled = placed.groupBy(*keys, "_bucket", "_rest").agg(F.sum("_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("_bucket"))
    # the rest is less than the leaf's tokens, so some bucket goes beyond it
    last = (filled.withColumn("_after", upto).where("_after > _rest").groupBy(*keys)
            .agg(F.min(F.struct("_bucket", (F.col("_after") - F.col("n")).alias("before"))).alias("x"))
            .select(*keys, F.col("x._bucket").alias("_last"), F.col("x.before").alias("_before")))
    last = materialize(last)
    inside = placed.join(last, keys).where("_bucket = _last")
    running = F.col("_before") + F.sum("_tokens").over(Window.partitionBy(*keys).orderBy("_place", "_id"))
    cuts = (inside.withColumn("_running", running).where("_running <= _rest").groupBy(*keys)
            .agg(F.max(F.struct("_place", "_id")).alias("_cut")))
    decided = materialize(plan.join(last, keys, "left").join(cuts, keys, "left"))

    before_cut = F.coalesce(F.struct("_place", "_id") <= F.col("_cut"), F.lit(False))
    partly = (F.col("_rest") > 0) & (F.coalesce(F.col("_bucket") < F.col("_last"), F.lit(False))
                                     | ((F.col("_bucket") == F.col("_last")) & before_cut))
    times = F.col("_whole") + F.coalesce(partly, F.lit(False)).cast("int")
    return (docs.select(*own, F.col("doc_id").alias("_id"), *named, tokens)
            .join(decided, keys).withColumn("_place", place).withColumn("_bucket", bucket)
            .select(*own, *[F.col(f"_{c}") for c in LEVELS], "_tokens", "_budget", times.alias("_times"))
            .where("_times > 0")
            .select("*", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("_epoch")).drop("_times"))


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens and leaf_budget of every chosen row of ``mix``."""
    chosen = mix(docs.select("doc_id", "lang", "source", "text"), **settings)
    return chosen.select("doc_id", F.col("_domain").alias("domain"), "lang", "source",
                         F.col("_epoch").alias("epoch"), F.col("_tokens").alias("n_tokens"),
                         F.col("_budget").alias("leaf_budget"))
