"""Whole pipelines, each one lazy plan over many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import scores
from citeweave.functions.text import coverage
from citeweave.operators import catalog, ranking, retrieval


def recommend(pools: DataFrame, as_of: int, k: int = 10, weights: dict[str, float] | None = None, temperature: float = 0.0, **filters) -> DataFrame:
    """The k best papers of each pool (query_id, paper_id, title, similarity, year, citation_count, most).

    Filters (see catalog.post_filters) go before ranking, so k rows are left where there are k; a temperature above 0
    re-ranks the pool's head for diversity.
    """
    df = catalog.post_filters(pools, **filters) if filters else pools
    w = scores.Weights(weights or dict(scores.WEIGHTS))
    n = ranking.POOL if temperature > 0 else k
    top = ranking.ranked(ranking.signals(df, as_of), w, n, ["query_id"])
    if temperature <= 0:
        return top
    return top.drop("rank").join(ranking.rerank(top, k, temperature), ["query_id", "paper_id"])


def answer_context(scored: DataFrame, pool: list[str], doc: str, paper: str, budget: int = 12_000, cap: int = 3) -> DataFrame:
    """(pool, used, coverage, refs): what an answer may be made from: passages ranked, made diverse and packed, with their references in order.

    The cap per paper holds in pools of more than one paper only. scored has (pool, doc, paper, section, length, dense, bm25, boost). Generating the answer is left to the caller.
    """
    ranked = retrieval.diverse(retrieval.fused(scored, pool, doc), pool, paper, "section", cap, lone=True)
    used = retrieval.packed(ranked, pool, "length", budget)
    first = F.min_by("dense", "rank")
    g = used.groupBy(*pool).agg(F.count("*").alias("used"), first.alias("_d"), F.array_sort(F.collect_list(F.struct("rank", F.col(doc).cast("string").alias("doc")))).alias("_l"))
    return g.select(*pool, "used", coverage(F.col("_d")).alias("coverage"), F.transform("_l", lambda x: x["doc"]).alias("refs"))
