"""Mixing sources to target weights.

A source with a share p of the tokens gets a weight proportional to p**alpha.
The exponent is found by bisection (several points a round, each round one
aggregation over the source table): the largest that still reaches a target
entropy, or the least that keeps every source's repetitions within a limit. An
entropy or limit that no exponent in [0, 1] meets is a ValueError. Weights times
the token budget are the sources' budgets. A source's documents are dealt by hash
to blocks; each epoch is a permutation of the source's blocks, and the last epoch
stops where the budget is used up: at a block, and within it at a document. In
that block a document that no longer fits is passed over for ``PASSES`` rounds;
what a budget then still lacks is its ``short``. Sums over blocks are small, so a
source that holds most of the corpus is never gathered in one place.

Defined results: a null source is the source ''. Tokens are words; null text has
none. Sources without tokens get weight zero and no documents. Rows with a null
doc_id take part; rows equal in doc_id, source and text are drawn together. Extra
columns stay untouched, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import saved, spare

#: Documents that a block is to have, about, and the most blocks of a source (beyond it blocks get larger).
BLOCK_DOCS, MOST_BLOCKS = 1024, 1 << 16
#: Rounds in which the block where a budget ends is searched for documents that still fit.
PASSES = 4
#: Times that a source may be gone through, unless the caller says otherwise.
MOST_EPOCHS = 1000


def _tokens(text: Column) -> Column:
    return F.size(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+")) - F.when(F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))) == 0, 1).otherwise(0)


def _order(id_col: str, source: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), source, F.coalesce(text, F.lit("")))


def measured(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """doc_id, source, tokens, ord per row."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), _tokens(F.col(text_col)).cast("long").alias("tokens"), _order(id_col, source, F.col(text_col), seed).alias("ord"))


def temperature(sources: DataFrame, total: int, budget: int, target_entropy: float | None = None, max_repeats: float | None = None, rounds: int = 6, points: int = 16) -> float:
    """The exponent. ``sources`` has tokens > 0 per source; entropy in nats."""
    share = F.col("tokens") / F.lit(float(total))

    def at(alphas: list[float]) -> list[tuple[float, float]]:
        """(entropy, most repetitions) for each exponent."""
        cols = []
        for a in alphas:
            p = F.pow(share, F.lit(a))
            cols += [F.sum(p), F.sum(p * F.log(share)), F.max(F.pow(share, F.lit(a - 1)))]
        row = list(sources.agg(*cols).first())
        return [(math.log(z) - a * x / z, budget / (z * total) * top) for a, z, x, top in zip(alphas, row[::3], row[1::3], row[2::3], strict=True)]

    def bisect(good, low_side: bool) -> float:
        """The border of ``good`` in [0, 1]: its largest member if it holds at low exponents, else its least one."""
        low, high = 0.0, 1.0
        for _ in range(rounds):
            grid = [low + (high - low) * i / points for i in range(points + 1)]
            ok = [good(*x) for x in at(grid)]
            if low_side:
                i = max((i for i, g in enumerate(ok) if g), default=-1)
                low, high = (grid[max(i, 0)], grid[min(i + 1, points)]) if i >= 0 else (grid[0], grid[0])
            else:
                i = min((i for i, g in enumerate(ok) if g), default=points)
                low, high = grid[max(i - 1, 0)], grid[i]
        return low if low_side else high

    alpha = 1.0
    if target_entropy is not None:
        alpha = bisect(lambda h, r: h >= target_entropy - 1e-12, True)
    if max_repeats is not None:
        least = bisect(lambda h, r: r <= max_repeats + 1e-12, False)
        alpha = max(alpha, least) if target_entropy is not None else least
    alpha = round(alpha, 9)
    entropy, repeats = at([alpha])[0]
    if target_entropy is not None and entropy < target_entropy - 1e-6:
        raise ValueError(f"no exponent reaches the entropy {target_entropy} within the repetition limit: {entropy} at {alpha}")
    if max_repeats is not None and repeats > max_repeats * (1 + 1e-6):
        raise ValueError(f"no exponent keeps to {max_repeats} repetitions: {repeats} at {alpha}")
    return alpha


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget_ratio: float = 1.0, target_entropy: float | None = None, max_repeats: float | None = 4.0, seed: int = 11, most_epochs: int = MOST_EPOCHS) -> tuple[DataFrame, DataFrame, int]:
    """(measured rows, plan, number of blocks).

    The plan has source, epoch, block, slot (where in the mix the block starts,
    0 to 1), weight, budget, short (tokens that the budget lacks) and, for the
    block in which a budget ends, cuts: the ranges of ord, each with the largest
    document, that are drawn. Only blocks that are drawn have a row.
    """
    rows = saved(measured(docs, id_col, source_col, text_col, seed), "measured")
    n_docs, total = rows.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    blocks = min(MOST_BLOCKS, max(1, math.ceil(n_docs / BLOCK_DOCS)))
    block = F.pmod("ord", F.lit(blocks)).alias("block")
    by_block = saved(rows.groupBy("source", block).agg(F.sum("tokens").alias("tokens")), "blocks")
    sources = saved(by_block.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "sources")
    budget = int(total * budget_ratio)
    alpha = temperature(sources, max(total, 1), budget, target_entropy, max_repeats) if total else 1.0
    power = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(alpha))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.select("source", F.col("tokens").alias("all_tokens"), (power / F.lit(z)).alias("weight")).withColumn("budget", F.round(F.col("weight") * budget).cast("long"))
    often = weighted.agg(F.max(F.struct((F.col("budget") / F.col("all_tokens")).alias("times"), "source")).alias("most")).first().most
    if often is not None and often.times > most_epochs:
        raise ValueError(f"the source {often.source!r} would be gone through {often.times:.0f} times; {most_epochs} is the most")
    epochs = weighted.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("budget") / F.col("all_tokens")).cast("long") - 1))).filter("epoch >= 0 AND budget > epoch * all_tokens")
    permuted = W.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "source", "epoch", "block"), "block").rowsBetween(W.unboundedPreceding, -1)
    placed = by_block.join(epochs, "source").withColumn("start", F.col("epoch") * F.col("all_tokens") + F.coalesce(F.sum("tokens").over(permuted), F.lit(0)))
    drawn = placed.filter(F.col("start") < F.col("budget"))
    ends = drawn.filter("start + tokens > budget").select("source", "epoch", "block", (F.col("budget") - F.col("start")).alias("left"))
    key = ["source", "epoch", "block"]
    inside = rows.withColumn("block", F.pmod("ord", F.lit(blocks))).join(ends, ["source", "block"]).groupBy(*key, "left", "ord").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
    inside = saved(inside.select(*key, "left", F.lit(None).cast("long").alias("low"), "ord", "tokens", "largest"), "inside")
    in_order, passes = W.partitionBy(*key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0), []
    for _ in range(PASSES):
        upto = inside.filter((F.col("largest") <= F.col("left")) & (F.col("low").isNull() | (F.col("ord") > F.col("low")))).withColumn("upto", F.sum("tokens").over(in_order))
        taken = upto.filter(F.col("upto") <= F.col("left")).groupBy(*key, "left", "low").agg(F.max("ord").alias("high"), F.max("upto").alias("took"))
        passes.append(saved(taken.select(*key, F.struct("low", "high", F.col("left").alias("largest")).alias("range"), "took"), "taken"))
        after = passes[-1].select(*key, F.col("range.high").alias("high"), "took")
        inside = inside.join(after, key).select(*key, (F.col("left") - F.col("took")).alias("left"), F.col("high").alias("low"), "ord", "tokens", "largest")
    every = passes[0]
    for more in passes[1:]:
        every = every.union(more)
    found = ends.join(every, key, "left").groupBy(*key).agg(F.collect_list("range").alias("cuts"), F.coalesce(F.sum("took"), F.lit(0)).alias("took"))  # a range a pass
    got = drawn.join(found, key, "left").withColumn("got", F.coalesce("took", "tokens"))
    short = got.groupBy("source").agg((F.max("budget") - F.sum("got")).alias("short"))
    plan = got.join(short, "source").select(*key, (F.col("start") / F.col("budget")).alias("slot"), "weight", "budget", "short", "cuts")
    return rows, saved(plan, "plan"), blocks


def _drawn(cuts: str, order: Column, tokens: Column) -> Column:
    """Whether a document of a drawn block is drawn itself."""
    inside = F.exists(cuts, lambda c: (c["low"].isNull() | (order > c["low"])) & (order <= c["high"]) & (tokens <= c["largest"]))
    return F.col(cuts).isNull() | inside


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """doc_id, source, tokens, epoch, block, slot, weight, budget, short: a row for each time that a document is drawn."""
    rows, plan, blocks = mix_plan(docs, id_col, source_col, text_col, **how)
    both = rows.withColumn("block", F.pmod("ord", F.lit(blocks))).join(plan, ["source", "block"]).filter(_drawn("cuts", F.col("ord"), F.col("tokens")))
    return both.select("doc_id", "source", "tokens", "epoch", "block", "slot", "weight", "budget", "short")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11, **how) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn; texts don't move unless the plan is too large to send."""
    _, plan, blocks = mix_plan(docs, id_col, source_col, text_col, seed=seed, **how)
    s, b, o, cuts = spare(docs.columns, "source", "block", "ord", "cuts")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({s: source, o: _order(id_col, source, F.col(text_col), seed)}).withColumn(b, F.pmod(o, F.lit(blocks)))
    small = plan.select(F.col("source").alias(s), F.col("block").alias(b), F.col("cuts").alias(cuts))
    return keyed.join(small, [s, b]).filter(_drawn(cuts, F.col(o), _tokens(F.col(text_col)))).select(*docs.columns)
