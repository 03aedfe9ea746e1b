"""Mixing sources to target weights by temperature.

The share of tokens of each source is raised to an exponent and normalised. The exponent, between 0 (all sources
alike) and 1 (as they are), is found by bisection: the largest one whose entropy reaches target_entropy, or the
smallest one that repeats no source more than max_repetition times. The weights become a table of blocks: the documents
of a source are dealt, by a hash of their ids, into blocks of about equal size, at most BLOCKS a source. A source's
budget is filled with whole passes over its blocks, each in a permutation of its own, and one pass that ends where the
budget does, to within half a block. position, from 0 to 1, is where in a source's sequence a copy comes: ordering all
rows by it gives a stream in which every stretch has about the target weights.

Without budget_tokens the budget is the least that takes every document at least once: nothing is lost, and small
sources are repeated.

Token counts are of words unless a column of counts is named. Sources are counted in one aggregation that combines
before the exchange. Each step of the bisection tries TRIES exponents at once in one aggregation over the sources, of
which only sums reach the driver. The passes over blocks are a table whose rows are counted: where they are few they go to
the documents, and no text is exchanged; else the documents of a hot source go to as many tasks as it has blocks.

Edge cases: null text has no tokens; such documents belong to blocks like others and come along with them. A null
source is a source of its own. A null id is dealt by its text; rows that repeat an id and text go to the same block.
Sources without any token, and a table without rows, have no weight and no rows in the result, except that without budget_tokens documents
of sources without tokens come once. Existing columns named mix_epoch or mix_position are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foretable.llm.common import WORD, Scratch, sized, text_or_empty

BLOCKS = 4096
TRIES = 16
PRECISION = 1e-9


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _measure(sources: DataFrame, exponents: list[float], total: float, budget: float | None) -> list[tuple[float, float]]:
    """For each exponent: the entropy of the weights, and the most that any source is repeated."""
    share = F.col("tokens") / F.lit(total)
    sums = []
    for i, x in enumerate(exponents):
        w = F.pow(share, F.lit(x))
        sums += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(share)).alias(f"l{i}"), F.max(w / share).alias(f"r{i}"), F.min(w / share).alias(f"q{i}")]
    row = sources.where("tokens > 0").agg(*sums).first()
    out = []
    for i, x in enumerate(exponents):
        z = row[f"z{i}"]
        # repetition of a source: its weight times the budget over its tokens; without a budget the least repeated is taken once
        most = row[f"r{i}"] / z * (budget / total) if budget else row[f"r{i}"] / row[f"q{i}"]
        out.append((math.log(z) - x * row[f"l{i}"] / z, most))
    return out


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repetition: float | None, budget: float | None, tries: int = TRIES) -> float:
    """Entropy falls and, with a budget, the most repeated source's passes fall as the exponent rises to 1. Both conditions
    given: entropy is served as far as the repetition limit allows. Where even 1 repeats too much, 1 is the answer."""
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    good = {
        "entropy": lambda h, r: target_entropy is None or h >= target_entropy - 1e-12,
        "repetition": lambda h, r: max_repetition is None or r <= max_repetition + 1e-12,
    }

    def search(holds, rising: bool) -> float:
        """The largest exponent where holds is true up to it (rising false), or the smallest from which it is (rising true)."""
        low, high = 0.0, 1.0
        while high - low > PRECISION:
            inner = [low + (high - low) * (k + 1) / (tries + 1) for k in range(tries)]
            flags = [holds(*x) for x in _measure(sources, inner, total, budget)]
            edges = [low, *inner, high]
            k = next((i for i, f in enumerate(flags) if f is rising), len(inner))
            low, high = edges[k], edges[k + 1]
        return high if rising else low

    x = 1.0
    if target_entropy is not None and not good["entropy"](*_measure(sources, [1.0], total, budget)[0]):
        x = search(good["entropy"], rising=False)
    if max_repetition is not None:
        if target_entropy is None:
            x = 0.0
        if not good["repetition"](*_measure(sources, [x], total, budget)[0]):
            x = max(x, search(good["repetition"], rising=True))
    return x


def mixing_plan(sources: DataFrame, exponent: float, budget: float | None) -> DataFrame:
    """(source, docs, tokens, weight, passes): passes is how often the source's tokens are used."""
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(total or 1))
    raw = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)))
    z, least = sources.agg(F.sum(raw), F.min(raw / share)).first()
    weight = F.coalesce(raw / F.lit(float(z or 1)), F.lit(0.0))
    passes = weight * F.lit(float(budget)) / F.col("tokens") if budget else raw / share / F.lit(float(least or 1))
    return sources.withColumns({"weight": weight, "passes": F.coalesce(F.when(F.col("tokens") > 0, F.round(passes, 12)), F.lit(0.0 if budget else 1.0))})


def mix_sources(
    docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget_tokens: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None, seed: int = 0, blocks: int = BLOCKS,
) -> DataFrame:
    """The rows of docs in the mixture, each as often as it is used, with mix_epoch (the pass, from 0) and mix_position. Sums of
    doubles depend on their order in the last digits, so passes and positions are rounded to 12."""
    names = [c for c in docs.columns if c not in ("mix_epoch", "mix_position")]
    tokens = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long") if tokens_col else token_count(text_or_empty(text_col))
    lot = F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.sha2(text_or_empty(text_col), 256)))
    # the caller's columns travel in one struct, so that none of their names can clash
    rows = docs.select(F.struct(*names).alias("row"), F.col(source_col).alias("of_source"), tokens.alias("tokens"), lot.alias("lot"))
    rows = rows.withColumn("of_block", F.pmod("lot", F.lit(blocks)).cast("int"))
    scratch = Scratch(docs.sparkSession, "mixing")
    dealt = scratch.store(rows.groupBy(F.col("of_source").alias("source"), F.col("of_block").alias("block")).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "blocks")
    sources = scratch.store(dealt.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), "sources")
    x = find_exponent(sources, target_entropy, max_repetition, budget_tokens)
    plan = mixing_plan(sources, x, budget_tokens)
    plan = plan.select(F.col("source").alias("of"), F.col("tokens").alias("all_tokens"), F.col("docs").alias("all_docs"), "passes")
    turns = dealt.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes").cast("int") - 1, F.lit(0)))))
    size = F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(F.col("docs") / F.col("all_docs"))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), F.col("epoch"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("size", size).withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0.0)))
    due = F.least(F.col("passes") - F.col("epoch"), F.lit(1.0))
    turns = turns.where((due >= 1 - 1e-9) | (F.col("start") + F.col("size") / 2 <= due)).where("passes > 0")
    uses = scratch.store(turns.select("source", "block", "passes", "epoch", "start", "size"), "uses")
    scratch.drop("blocks", "sources")
    at = F.pmod(F.xxhash64(F.col("lot"), F.col("epoch")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    mixed = rows.drop("tokens").join(sized(uses), F.col("of_source").eqNullSafe(F.col("source")) & (F.col("of_block") == F.col("block")))
    position = F.least(F.round((F.col("epoch") + F.col("start") + at * F.col("size")) / F.greatest(F.col("passes"), F.lit(1e-12)), 12), F.lit(1.0))
    return mixed.select(*(F.col("row")[c].alias(c) for c in names), F.col("epoch").cast("int").alias("mix_epoch"), position.alias("mix_position"))
