"""Mixing sources to target weights (10): temperature mixing realised as block permutations.

A source's weight is its token share to the power of an exponent in [0, 1], normalised. The
exponent is bisected (CUTS parts at a time): the smallest that repeats no source more than
max_repeats times, or the one that gives a target entropy. Limits that no exponent meets (a budget
of more than max_repeats passes over the corpus, an entropy below that of the unchanged shares)
raise a ValueError. Each source gets its weight's part of
the token budget: whole passes over its documents (epochs) and a last, partial one. In each epoch
a source's documents are dealt by hash into blocks of about block_tokens tokens, ordered by hash
inside; the partial epoch takes blocks in order, and of the block in which the budget ends, the
documents that begin before that end. slot in [0, 1) spreads a source's blocks over the run.

Neither sources nor documents are gathered on the driver: the bisection sees sums alone. A hot
source's blocks are summed in spans of SPAN blocks first, so that no window runs over all of them.
The result names the uses of documents; their texts stay where they are and join by doc_id.

Cases: a null source is the source "". A null or empty text has 0 tokens and comes with each
whole epoch. Sources without tokens have weight 0 and no rows. Rows that repeat are dealt each
on their own. No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, written

CUTS, ROUNDS, SPAN = 16, 7, 1024


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))).cast("long")


def _measures(shares: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float]]:
    """(entropy, greatest repetition) of the mix at each exponent, in one pass."""
    p = F.col("lnp")
    terms = []
    for i, a in enumerate(exponents):
        terms += [F.sum(F.exp(p * a)).alias(f"z{i}"), F.sum(F.exp(p * a) * p * a).alias(f"s{i}"), F.max(p * (a - 1)).alias(f"r{i}")]
    row = shares.agg(*terms).first()
    return [(math.log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"], math.exp(row[f"r{i}"]) * budget / row[f"z{i}"]) for i in range(len(exponents))]


def find_exponent(shares: DataFrame, budget: float, *, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """shares has lnp, the log of each source's token share. Entropy and repetition fall with the exponent.

    A target entropy over that of equal weights gives equal weights.
    """
    low, high = 0.0, 1.0
    if target_entropy is None and max_repeats is None:
        return 1.0
    fits = lambda m: (target_entropy is None or m[0] <= target_entropy) and (max_repeats is None or m[1] <= max_repeats)
    equal, unchanged = _measures(shares, [low, high], budget)
    if fits(equal):
        return low
    if not fits((unchanged[0] - 1e-9, unchanged[1] * (1 - 1e-9))):
        raise ValueError(f"no exponent in [0, 1] meets the limits: at 1 the entropy is {unchanged[0]:.6f} and the corpus is used {unchanged[1]:.6f} times")
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
        ok = next((i for i, m in enumerate(_measures(shares, grid, budget)) if i and fits(m)), CUTS)
        low, high = grid[ok - 1], grid[ok]
    return high


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_ratio: float = 1.0, target_entropy: float | None = None, max_repeats: float | None = None, block_tokens: int = 1 << 20, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, slot): a row for each time a document is used."""
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), token_count(F.col(text_col)).alias("n_tokens"), F.xxhash64(F.lit(seed), F.col(text_col)).alias("h")), "tokens")
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = written(sums.withColumn("lnp", F.log(F.col("tokens") / F.lit(float(max(total, 1))))), "shares")
    exponent = find_exponent(shares, budget_ratio, target_entropy=target_entropy, max_repeats=max_repeats) if total else 1.0
    z = (shares.agg(F.sum(F.exp(F.col("lnp") * exponent))).first()[0] or 1.0) if total else 1.0
    budget = F.exp(F.col("lnp") * exponent) / F.lit(z) * F.lit(total * budget_ratio)
    plan = shares.withColumn("budget", budget).select(
        "source", F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("whole"), F.ceil(F.col("tokens") / block_tokens).cast("int").alias("blocks"),
        (F.col("budget") - F.floor(F.col("budget") / F.col("tokens")) * F.col("tokens")).alias("rest"), (F.col("budget") / F.col("tokens")).alias("passes"),
    )
    plan = written(plan, "plan")

    used = rows.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    order = F.xxhash64(F.lit(seed), "epoch", "doc_id", "h")
    used = used.withColumn("order", order).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "order"), F.col("blocks")).cast("int"))
    whole = used.where("epoch < whole")
    last = used.where("epoch = whole and rest > 0")
    filled = last.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    spans = filled.groupBy("source", F.floor(F.col("block") / SPAN).alias("span")).agg(F.sum("tokens").alias("span_tokens"))
    ahead = lambda tokens, order, *keys: F.coalesce(F.sum(tokens).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("source", "span", ahead("span_tokens", "span", "source").alias("span_before"))
    filled = filled.withColumn("span", F.floor(F.col("block") / SPAN)).withColumn("inside", ahead("tokens", "block", "source", "span")).join(spans, ["source", "span"])
    filled = filled.select("source", "block", "tokens", (F.col("span_before") + F.col("inside")).alias("before"))
    last = last.join(filled, ["source", "block"]).where("before < rest")
    inside = last.where("before + tokens <= rest")
    inner = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("order", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = last.where("before + tokens > rest").withColumn("inner", inner).where("before + inner < rest")
    names = ["doc_id", "source", "n_tokens", "epoch", "block", "blocks", "passes"]
    chosen = whole.select(names).unionByName(inside.select(names)).unionByName(edge.select(names))
    slot = (F.col("epoch") + (F.col("block") + 0.5) / F.col("blocks")) / F.greatest("passes", F.lit(1.0))
    return chosen.select("doc_id", "source", "n_tokens", "epoch", "block", F.least(slot, F.lit(1.0)).alias("slot"))
