"""Mixing of sources to target weights by temperature, realised as budgeted block permutations.

Weights are source token shares raised to one exponent and normalised. The exponent is bisected: the largest one in
[0, 1] whose weights reach the target entropy, but not below the one at which a source would be repeated more often
than allowed. A source's quota of the token budget is laid out as epochs over its documents. Each epoch is its own
permutation of the source's blocks (hash buckets of documents); the last epoch stops at the quota, inside a block at a
threshold on the documents' hash.

Sources' totals reach the driver up to max_sources of them; beyond that the exponent is bisected by small aggregations
over the table of totals. Blocks are summed before any shuffle, at most max_blocks a source; documents meet the plan by
(source, block), so a source that holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, read_table, store

def weights_at(shares: list[float], exponent: float) -> list[float]:
    raw = [s**exponent for s in shares]
    return [r / sum(raw) for r in raw]


def entropy(weights: list[float]) -> float:
    """In units of the largest possible one; 1 for a single source."""
    return -sum(w * math.log(w) for w in weights if w > 0) / math.log(len(weights)) if len(weights) > 1 else 1.0


def solve_exponent(shares: list[float], budget_ratio: float, target_entropy: float, max_repeat: float) -> float:
    """The exponent for positive shares; budget_ratio is the budget in units of all tokens.

    Entropy falls and, with it, repetition falls as the exponent rises. When even the natural shares repeat a source
    more often than allowed, they are used.
    """
    repeat = lambda a: max(w * budget_ratio / s for w, s in zip(weights_at(shares, a), shares, strict=True))
    return _solve(lambda a: entropy(weights_at(shares, a)), repeat, target_entropy, max_repeat)


def _solve(entropy_at: Callable[[float], float], repeat_at: Callable[[float], float], target_entropy: float, max_repeat: float) -> float:
    """The largest exponent in [0, 1] with the target entropy, but not below the one with the allowed repetition."""

    def least(ok: Callable[[float], bool]) -> float:
        """The smallest exponent that satisfies a condition which holds from some exponent on, 1 at most."""
        if ok(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high

    flat = least(lambda a: entropy_at(a) < target_entropy) if entropy_at(1.0) < target_entropy else 1.0  # it holds below
    return max(flat, least(lambda a: repeat_at(a) <= max_repeat))


def solve_in_spark(totals: DataFrame, budget_ratio: float, target_entropy: float, max_repeat: float) -> float:
    """solve_exponent() where the positive shares are a table (share) of any length: one small aggregation a step."""
    n = totals.count()

    def at(exponent: float) -> tuple[float, float]:
        """Entropy, and the largest repetition, of the weights at an exponent."""
        raw = F.pow("share", F.lit(exponent))
        z, logs, most = totals.agg(F.sum(raw), F.sum(raw * F.log("share")), F.max(raw / F.col("share"))).first()
        return ((math.log(z) - exponent * logs / z) / math.log(n) if n > 1 else 1.0), most / z * budget_ratio

    return _solve(lambda a: at(a)[0], lambda a: at(a)[1], target_entropy, max_repeat)


def mix_plan(
    measured: DataFrame,
    budget_tokens: int | None,
    target_entropy: float,
    max_repeat: float,
    block_tokens: int,
    max_sources: int,
    max_blocks: int,
    seed: int,
) -> tuple[DataFrame, DataFrame]:
    """Of the documents' (src, tokens, mark): the plan, a row per (source, epoch, block), and the sources' block counts."""
    totals, _ = store(measured.groupBy("src").agg(F.sum("tokens").alias("total")), "source-totals")
    n, total = totals.agg(F.count("*"), F.coalesce(F.sum("total"), F.lit(0))).first()
    budget = total if budget_tokens is None else budget_tokens
    live = totals.where("total > 0").withColumn("share", F.col("total") / F.lit(float(max(total, 1))))
    exponent = 1.0
    if total and n <= max_sources:
        shares = sorted(r["share"] for r in live.select("share").collect())
        exponent = solve_exponent(shares, budget / total, target_entropy, max_repeat)
    elif total:
        exponent = solve_in_spark(live.select("share"), budget / total, target_entropy, max_repeat)
    raw = F.pow("share", F.lit(exponent))
    z = live.agg(F.sum(raw)).first()[0] or 1.0
    weight = raw / F.lit(z)
    blocks = F.least(F.lit(max_blocks).cast("long"), F.ceil(F.col("total") / block_tokens))
    some = live.select(F.col("src").alias("psrc"), "total", weight.alias("weight"), F.rint(weight * F.lit(float(budget))).alias("quota"), blocks.alias("blocks"))
    bare = totals.where("total <= 0").select(F.col("src").alias("psrc"), F.lit(0).cast("long").alias("total"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("quota"), F.lit(1).cast("long").alias("blocks"))
    per_source, _ = store(some.unionByName(bare), "sources")
    if n <= max_sources:
        per_source = F.broadcast(per_source)
    blocked = measured.join(per_source, F.col("src").eqNullSafe(F.col("psrc"))).withColumn("block", F.pmod("mark", "blocks"))
    sizes = blocked.groupBy("psrc", "total", "weight", "quota", "blocks", "block").agg(F.sum("tokens").alias("tokens"))
    sizes, _ = store(sizes, "blocks")
    # an epoch for every whole pass over the source, and one for the rest; a source without tokens is used once
    passes = F.when(F.col("total") > 0, F.ceil(F.col("quota") / F.col("total")).cast("int")).otherwise(1)
    epochs = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(passes, F.lit(1)) - 1)))
    order = Window.partitionBy("psrc", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    laid = epochs.withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
    room = F.col("quota") - F.col("epoch") * F.col("total") - F.col("before")
    laid = laid.withColumn("room", F.when(F.col("total") > 0, room).otherwise(F.lit(1.0))).where("room > 0")
    laid, _ = store(laid, "layout")
    # the block in which a source's quota ends, one a source: its documents up to the quota, in the order of their hash
    edge = laid.where("tokens > room").select(F.col("psrc").alias("esrc"), F.col("block").alias("eblock"), "room")
    inside = blocked.join(edge, F.col("psrc").eqNullSafe(F.col("esrc")) & (F.col("block") == F.col("eblock")))
    # hash range splits it again: whole ranges are summed, and only the range where the quota ends is put in order
    fine = F.shiftright("mark", 54).alias("range")
    ranges = inside.select("esrc", "room", fine, "tokens").groupBy("esrc", "room", "range").agg(F.sum("tokens").alias("n"))
    by_range = Window.partitionBy("esrc").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("upto", F.sum("n").over(by_range)).where("upto > room")
    last = ranges.groupBy(F.col("esrc").alias("rsrc")).agg(F.min_by(F.struct("range", (F.col("upto") - F.col("n")).alias("base")), "range").alias("r"))
    ending = inside.withColumn("range", fine).join(last, F.col("esrc").eqNullSafe(F.col("rsrc")) & (F.col("range") == F.col("r.range")))
    in_order = Window.partitionBy("esrc").orderBy("mark")  # rows with one hash count together
    ending = ending.withColumn("used", F.col("r.base") + F.sum("tokens").over(in_order))
    cut = ending.groupBy(F.col("esrc").alias("csrc")).agg(
        F.coalesce(F.max(F.when(F.col("used") <= F.col("room"), F.col("mark"))), F.min(F.col("range") * F.lit(1 << 54)) - 1).alias("cut")
    )
    plan = laid.join(cut, F.col("psrc").eqNullSafe(F.col("csrc")), "left").select(
        "psrc",
        "blocks",
        "block",
        "epoch",
        "weight",
        F.when(F.col("tokens") > F.col("room"), F.col("cut")).alias("cut"),
        F.when(F.col("total") > 0, (F.col("epoch") * F.col("total") + F.col("before")) / F.col("quota")).otherwise(0.0).alias("at"),
    )
    plan, _ = store(plan, "mix-plan")
    return plan, per_source


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    budget_tokens: int | None = None,
    target_entropy: float = 0.95,
    max_repeat: float = 2.0,
    block_tokens: int = 1_000_000,
    max_sources: int = 100_000,
    max_blocks: int = 4096,
    seed: int = 7,
    prefix: str = "mix_",
    with_text: bool = True,
) -> DataFrame:
    """docs, each row once per epoch that it is dealt to, with mix_epoch, mix_block, mix_weight, mix_tokens and mix_at.

    Without with_text the text is left out, and the texts are read once instead of twice.

    mix_at runs from 0 to 1 along each source's stream; ordered by it, sources interleave at their target weights. A
    text's tokens are its runs of characters other than white space; null and empty texts have none and follow their
    block. Without a budget it is the number of all tokens. A null source is a source. A source without any token is
    used once. Blocks are of block_tokens, or larger where a source would have more than max_blocks; up to max_sources
    sources are solved on the driver and broadcast, more are solved and joined in Spark. Rows with the same doc_id and text are dealt alike. Columns with the names of the new ones are replaced.
    """
    kept = docs.drop(*(prefix + c for c in ("epoch", "block", "weight", "tokens", "at")))
    counted, mark, src, blocks = (fresh(kept, c) for c in ("tokens", "mark", "source", "blocks"))
    measured = kept.withColumn(counted, F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long"))
    measured = measured.withColumn(mark, F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)))
    columns = kept.columns
    if not with_text:
        columns = [c for c in columns if c != text]
        measured, _ = store(measured.drop(text), "measured")
    sizes = measured.select(F.col(source).alias("src"), F.col(counted).alias("tokens"), F.col(mark).alias("mark"))
    if with_text:
        sizes, _ = store(sizes, "measured")
    plan, per_source = mix_plan(sizes, budget_tokens, target_entropy, max_repeat, block_tokens, max_sources, max_blocks, seed)
    sized = per_source.select(F.col("psrc").alias(src), F.col("blocks").alias(blocks))
    dealt = measured.join(sized, F.col(source).eqNullSafe(F.col(src))).drop(src)  # broadcast up to max_sources rows
    laid = {c: fresh(kept, f"plan_{c}") for c in plan.columns}
    plan = plan.select(*(F.col(c).alias(n) for c, n in laid.items()))
    here = F.col(source).eqNullSafe(F.col(laid["psrc"])) & (F.pmod(F.col(mark), F.col(blocks)) == F.col(laid["block"]))
    out = dealt.join(plan, here).where(F.col(laid["cut"]).isNull() | (F.col(mark) <= F.col(laid["cut"])))
    return out.select(
        *columns,
        F.col(laid["epoch"]).alias(f"{prefix}epoch"),
        F.col(laid["block"]).alias(f"{prefix}block"),
        F.col(laid["weight"]).alias(f"{prefix}weight"),
        F.col(counted).alias(f"{prefix}tokens"),
        F.col(laid["at"]).alias(f"{prefix}at"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs, with_text=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them, all columns as they were."""
    return mixed(docs).select(docs.columns)
