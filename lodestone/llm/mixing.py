"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget runs down a tree of domain, language and source. Each node's
share follows its weight among its siblings but stops at what the node can
give: its tokens times ``max_epochs``. What one child cannot give goes to its
siblings in proportion to their weights; only what the siblings cannot give
either lowers the parent's own capacity, and so falls to the parent's siblings.
Shares are whole tokens and add up exactly; the last tokens go to the largest
remainders, ties by name.

A leaf with budget b and t tokens is read b div t times in full; of the next
epoch it gives a prefix of b mod t tokens, in an order seeded by (seed, epoch).
The prefix is found without sorting a leaf in one task: the order keys fall in
hash buckets, the buckets' sums give each bucket's start, and only within a
bucket are rows put in order.

Token counts are words here (runs without white space) unless a column is named.
Weights are whole numbers up to 10,000; a product of tokens and weights must
stay below 2^63, which holds up to 9e14 tokens.

Cases: a null text has no tokens and is never taken in part; null languages and
sources are leaves of their own; a weight of 0 takes nothing; rows with equal
doc_id count each by itself; rows with one order key (equal doc_id and text) are
put in order by their tokens and are alike otherwise; of a very long text only
its words are counted, and it is never cut; an empty table gives no rows; a
budget beyond all capacity takes all of it; further columns are ignored by
``mixture`` and kept by ``select``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import stored

LEVELS = ("domain", "lang", "source")
#: Leaf tables up to this number of rows are broadcast, at some 100 bytes each.
MOST_BROADCAST = 100_000


def domain_of(source: Column) -> Column:
    """The domain that a source of the table belongs to, by its number."""
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT)")
    return F.when(source.isNull() | n.isNull(), "other").when(n < 10, "web").when(n < 15, "books").otherwise("forums")


@dataclass(frozen=True)
class Recipe:
    """Target weights by level and name, with 1 for names not listed."""

    weights: dict[str, dict[str, int]] = field(default_factory=lambda: {"domain": {"web": 5, "books": 3, "forums": 2, "other": 1}, "lang": {"en": 6, "fr": 2, "de": 1, "es": 1}, "source": {"src0": 3}})
    budget: int | None = None  # tokens; None: as many as there are
    share: float = 1.0  # of the tokens that there are, where no budget is given
    max_epochs: int = 4
    seed: int = 17

    def weight(self, level: str) -> Column:
        pairs = [x for k, v in self.weights.get(level, {}).items() for x in (F.lit(k), F.lit(v))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(1)).cast("long") if pairs else F.lit(1).cast("long")


def measured(docs: DataFrame, tokens: Column | None = None, carry: tuple[Column, ...] = ()) -> DataFrame:
    """The narrow row of each document: its leaf, its tokens and its text's hash."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    count = F.regexp_count(text, F.lit("[^ \t-\r]+")) if tokens is None else tokens
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("source")).alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"), count.cast("long").alias("n_tokens"), F.md5(text.cast("binary")).alias("digest"), *carry,
    )


def _fill(nodes: DataFrame, parents: tuple[str, ...], level: str) -> DataFrame:
    """Divide each parent's ``budget`` among its children by ``weight`` within ``cap``, as column ``given``."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("weight"), level)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    n = nodes.where("weight > 0").withColumn("left_over", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("others", F.sum("weight").over(rest))
    n = n.withColumn("full", F.min((F.col("cap") * F.col("others") <= F.col("weight") * F.col("left_over")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    n = n.withColumn("r", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)).withColumn("w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(by))
    n = n.withColumn("least", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(r * weight) div nullif(w, 0)"))).withColumn("rest", F.when(F.col("full"), F.lit(-1)).otherwise(F.expr("(r * weight) % nullif(w, 0)")))
    n = n.withColumn("more", F.col("budget") - F.sum("least").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.col("rest").desc(), level)))
    given = F.col("least") + F.when(~F.col("full") & (F.col("k") <= F.col("more")), 1).otherwise(0)
    return n.withColumn("given", given.cast("long")).drop("left_over", "others", "full", "r", "w", "least", "rest", "more", "k", "budget", "weight")


def budgets(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """One row a leaf: its tokens, the budget given to it, full epochs and the part of the next."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumns({f"w_{k}": recipe.weight(k) for k in LEVELS})
    usable = (F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0)
    leaves = leaves.withColumn("cap", F.when(usable, F.col("tokens") * recipe.max_epochs).otherwise(0))
    want = F.lit(recipe.budget) if recipe.budget is not None else F.floor(F.sum("tokens") * recipe.share)
    root = leaves.agg(F.least(want, F.sum("cap")).cast("long").alias("budget"))
    given = root
    for depth, level in enumerate(LEVELS):
        path, parents = LEVELS[: depth + 1], LEVELS[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.first(f"w_{level}").alias("weight"))
        nodes = nodes.join(given, list(parents)) if parents else nodes.crossJoin(F.broadcast(given))  # the root is one row
        given = _fill(nodes, parents, level).select(*path, F.col("given").alias("budget"))
    out = leaves.join(given, list(LEVELS), "left").withColumn("budget", F.coalesce("budget", F.lit(0)))
    return out.select(*LEVELS, "tokens", "budget", F.expr("coalesce(budget div nullif(tokens, 0), 0)").alias("full_epochs"), F.expr("coalesce(budget % nullif(tokens, 0), 0)").alias("part"))


def _taken(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """The rows with full_epochs and part_tokens."""
    leaves = stored(budgets(rows, recipe), "budgets")
    small = leaves.count() <= MOST_BROADCAST
    side = F.broadcast(leaves) if small else leaves
    key = F.md5(F.concat_ws("|", F.lit(str(recipe.seed)), F.col("full_epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest")).cast("binary"))
    placed = rows.join(side.select(*LEVELS, "full_epochs", "part"), list(LEVELS)).withColumn("okey", key).withColumn("bucket", F.substring("okey", 1, 3))
    sums = placed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("s"))
    # at most 4096 rows a leaf
    starts = sums.select(*LEVELS, "bucket", F.coalesce(F.sum("s").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    starts = stored(starts, "starts")
    if starts.count() <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    order = Window.partitionBy(*LEVELS, "bucket").orderBy("okey", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    part = F.least(F.col("n_tokens"), F.greatest(F.lit(0), F.col("part") - F.col("start") - F.col("ahead")))
    return inner.join(starts, [*LEVELS, "bucket"]).withColumn("part_tokens", part.cast("long"))


def mixture(docs: DataFrame, recipe: Recipe = Recipe(), tokens: Column | None = None) -> DataFrame:
    """One row a document: its leaf, its tokens, how often it is read in full and how much of the next epoch."""
    taken = _taken(stored(measured(docs, tokens), "mixing"), recipe)
    return taken.select("doc_id", *LEVELS, "n_tokens", "full_epochs", "part_tokens", (F.col("full_epochs") * F.col("n_tokens") + F.col("part_tokens")).alias("taken_tokens"))


def select(docs: DataFrame, recipe: Recipe = Recipe(), tokens: Column | None = None) -> DataFrame:
    """The mixture's documents with all their columns, once for each epoch that takes some of their tokens.

    Documents come whole: the one at the end of a leaf's prefix is not cut. What
    has no tokens is in the mixture as often as its leaf is read in full.
    """
    rows = stored(measured(docs, tokens, (F.monotonically_increasing_id().alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))), "mixing")
    taken = _taken(rows.drop("row"), recipe).select("row_id", (F.col("full_epochs") + F.when(F.col("part_tokens") > 0, 1).otherwise(0)).cast("int").alias("times")).where("times > 0")
    # row_id was written with the rows, so it is fixed
    return rows.select("row_id", "row").join(taken, "row_id").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
