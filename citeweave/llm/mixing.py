"""Mixing sources to target weights.

Documents of a source lie in blocks by a hash of their id, which is a random permutation cut into disjoint blocks.
From the blocks' token sums the driver plans, per mix, how often each source is passed over and which of its blocks
the last pass takes: each that still fits, and of one more block each document that still fits. A multivariate-
hypergeometric splitting tree then divides the exact counts of block draws among the output shards, halving the shards
at each level. Documents join the plan by (source, block) and are put in random order within their shard. The number
of blocks follows the tokens up to MAX_BLOCKS, so the plan is bounded by sources x MAX_BLOCKS x repeats.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.ids import BLANK
from citeweave.llm.tokens import VOCABULARY, token_counts
from citeweave.session import cut, spread, table

#: Tokens of a block, about, and how many blocks a source has.
BLOCK_TOKENS, MIN_BLOCKS, MAX_BLOCKS = 4_000_000, 256, 16_384
#: Rows of a plan that is broadcast; a larger one is joined as Spark sees fit.
BROADCAST_ROWS = 200_000
SEED = 7_919
#: Tokens of an output shard, about; there are at least MIN_SHARDS and at most MAX_SHARDS.
SHARD_TOKENS, MIN_SHARDS, MAX_SHARDS = 50_000_000, 8, 4096


def source_key(c):
    """A source without outer blanks and case; null where nothing is left."""
    s = F.lower(F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", ""))
    return F.when(s != "", s)


def split_quotas(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): counts of each source divided exactly among shards of sizes that differ by one at most."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    size = np.full(shards, counts.sum() // shards)
    size[: counts.sum() % shards] += 1

    def split(lo: int, hi: int, left: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = left
            return
        mid = (lo + hi) // 2
        half = rng.multivariate_hypergeometric(left, int(size[lo:mid].sum()), method="marginals")
        split(lo, mid, half)
        split(mid, hi, left - half)

    split(0, shards, counts.astype(np.int64))
    return out


def plan_mix(targets: dict[str, tuple[float, int]], blocks: dict[str, dict[int, int]]) -> tuple[float, dict[str, tuple[int, list[int], tuple[int, float] | None]]]:
    """(total tokens, {source: (full passes, blocks of the last pass, (block taken in part, its tokens) or None)}).

    The total is the largest at which no source is needed more often than its max_repeats. Sources without tokens
    take no part; the weights of the others keep their proportion.
    """
    have = {s: sum(blocks[s].values()) for s in targets if sum(blocks.get(s, {}).values()) > 0 and targets[s][0] > 0 and targets[s][1] > 0}
    if not have:
        return 0.0, {}
    weight = sum(targets[s][0] for s in have)
    total = min(have[s] * targets[s][1] / (targets[s][0] / weight) for s in have)
    plan = {}
    for s, n in have.items():
        need = total * targets[s][0] / weight
        passes = min(targets[s][1], int(need / n + 1e-9))
        rest, taken, part = need - passes * n, [], None
        if passes < targets[s][1]:
            over = None
            for b in sorted(blocks[s]):
                if blocks[s][b] <= rest + 1e-6:
                    taken.append(b)
                    rest -= blocks[s][b]
                elif over is None or blocks[s][b] > blocks[s][over]:
                    over = b
            part = (over, rest) if over is not None and rest >= 1 else None
        plan[s] = (passes, taken, part)
    return total, plan


def mix(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(mix, source, doc_id, copy, shard, order_key, tokens): one row per time a document is taken.

    sized has (doc_id, source, tokens), targets (mix, source, target_weight, max_repeats). Sources are compared
    without case and outer blanks. Documents without tokens or source are never taken; neither are targets with a
    null, a weight or repeats not above 0 (of a repeated target weights add up and the least max_repeats holds). No
    document is taken more than max_repeats times. Copies of a text under several doc_ids count each. An empty input
    gives no rows. order_key orders a shard at random.
    """
    spark = sized.sparkSession
    want: dict[str, dict[str, tuple[float, int]]] = {}
    rows = targets.select("mix", source_key(F.col("source")).alias("s"), "target_weight", "max_repeats").where("mix is not null and s is not null and target_weight > 0 and max_repeats > 0 and not isnan(target_weight)").collect()  # the small table of targets
    for r in sorted(rows):
        w, m = want.setdefault(r["mix"], {}).get(r["s"], (0.0, 2**31))
        want[r["mix"]][r["s"]] = (w + r["target_weight"], min(m, r["max_repeats"]))
    names = sorted({s for t in want.values() for s in t})
    docs = sized.select("doc_id", source_key(F.col("source")).alias("source"), "tokens").where((F.col("tokens") > 0) & F.col("source").isin(names))
    docs = cut(docs)
    most = docs.groupBy("source").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] or 0
    n_blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, math.ceil(most / BLOCK_TOKENS)))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n_blocks)).cast("int"))
    blocks: dict[str, dict[int, int]] = {}
    for r in docs.groupBy("source", "block").agg(F.sum("tokens").alias("t")).collect():  # at most sources x MAX_BLOCKS
        blocks.setdefault(r["source"], {})[r["block"]] = r["t"]
    draws, parts = [], []
    for name in sorted(want):
        total, plan = plan_mix(want[name], blocks)
        units = {s: [(b, c) for c in range(passes) for b in sorted(blocks[s])] + [(b, passes) for b in taken] + ([(part[0], passes)] if part else []) for s, (passes, taken, part) in plan.items()}
        order = sorted(units)
        counts = np.array([len(units[s]) for s in order], dtype=np.int64)
        if not counts.sum():
            continue
        shards = int(min(MAX_SHARDS, counts.sum(), max(MIN_SHARDS, math.ceil(total / SHARD_TOKENS))))
        rng = np.random.default_rng([seed, *name.encode()])
        quotas = split_quotas(counts, shards, rng)
        for k, s in enumerate(order):
            at = 0
            shuffled = [units[s][i] for i in rng.permutation(len(units[s]))]
            part = plan[s][2]
            for shard in range(shards):
                for b, c in shuffled[at : at + quotas[shard, k]]:
                    limit = float(part[1]) if part and (b, c) == (part[0], plan[s][0]) else None
                    (draws if limit is None else parts).append((name, s, b, c + 1, shard, limit))
                at += quotas[shard, k]
    schema = "mix string, source string, block int, copy int, shard int, room double"
    plan = spark.createDataFrame(pd.DataFrame(draws, columns=[x.split()[0] for x in schema.split(", ")]), schema) if draws else spark.createDataFrame([], schema)
    whole = docs.join(F.broadcast(plan) if len(draws) <= BROADCAST_ROWS else plan, ["source", "block"])
    some = docs.join(F.broadcast(spark.createDataFrame(parts, schema)), ["source", "block"])  # one block per mix and source

    cols = whole.columns

    def fill(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["order", "doc_id"])
        room, fits = t["room"].iloc[0] + 0.5, []
        for n in t["tokens"]:
            fits.append(n <= room)
            room -= n if fits[-1] else 0
        return t.loc[fits, cols]

    ordered = some.withColumn("order", F.xxhash64("doc_id", F.lit(seed + 1)))
    some = ordered.groupBy("mix", "source").applyInPandas(fill, whole.schema)  # one block of a source
    taken = whole.unionByName(some)
    return taken.select("mix", "source", "doc_id", "copy", "shard", F.xxhash64("doc_id", "copy", "mix", F.lit(seed + 2)).alias("order_key"), "tokens")


def _mixed(spark, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    sized = token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id"), "text", ["doc_id", "source"], path)
    return mix(sized, table(spark, sf_dir, "mix_targets"))


def p7_mix(spark, sf_dir: str) -> DataFrame:
    """Each draw, shards in random order within themselves."""
    return _mixed(spark, sf_dir).repartition("mix", "shard").sortWithinPartitions("mix", "shard", "order_key", "doc_id")


def p7_taken(spark, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).groupBy("mix", "source", "doc_id").agg(F.count("*").alias("times"))


def p7_shares(spark, sf_dir: str) -> DataFrame:
    """Per mix and source: the share stated, the target share, the share reached, tokens, draws, the most times a document is taken.

    Target shares are the stated ones among the sources that have tokens; those of the others are 0.
    """
    got = _mixed(spark, sf_dir).groupBy("mix", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("draws"), F.max("copy").alias("most_times"))
    want = table(spark, sf_dir, "mix_targets").groupBy("mix", source_key(F.col("source")).alias("source")).agg(F.sum("target_weight").alias("w"))
    both = want.join(got, ["mix", "source"], "left")
    every = Window.partitionBy("mix")  # one row per target
    both = both.withColumn("v", F.when(F.col("tokens") > 0, F.col("w")).otherwise(0.0))
    share = lambda c: F.round(F.col(c) / F.sum(c).over(every), 6)
    return both.select(
        "mix", "source", share("w").alias("stated_share"), share("v").alias("target_share"), F.coalesce(share("tokens"), F.lit(0.0)).alias("actual_share"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "draws", "most_times")),
    )


QUERIES = {"p7_mix": p7_mix, "p7_taken": p7_taken, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
