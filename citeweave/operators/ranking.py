"""Multi-signal ranking: pools per query, signals, weighted sum, re-ranking for diversity, ablations.

A query is a paper; its pool are the papers most similar to it, and one job ranks all pools. Greedy re-ranking runs per query over a pool cut to POOL rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import scores, text
from citeweave.operators.dense import top_similar
from citeweave.session import table

# Fixed values.
POOL_FACTOR, MIN_POOL, POOL, JUDGE, TEMPERATURE = 3, 20, 120, 0.10, 0.3
METHODS = ["full", "no_embedding", "no_recency", "no_citation", "no_author", "citation_only", "embedding_only"]
AS_OF = 2002


def library(part: DataFrame, lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """(paper_id, title, year, citation_count, most): parts as papers, orders as citers, suppliers as authors.

    most is how many papers the paper's most frequent author has.
    """
    cites = lineitem.groupBy(F.col("l_partkey").alias("paper_id")).agg(F.count_distinct("l_orderkey").alias("citation_count"), F.max(F.year("l_shipdate")).alias("year"))
    pairs = lineitem.select(F.col("l_partkey").alias("paper_id"), F.col("l_suppkey").alias("author")).distinct()
    freq = pairs.groupBy("author").agg(F.count("*").alias("f"))
    most = pairs.join(freq, "author").groupBy("paper_id").agg(F.max("f").alias("most"))
    named = part.select(F.col("p_partkey").alias("paper_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title"), "p_size", "p_retailprice")
    return named.join(cites, "paper_id", "left").join(most, "paper_id", "left")


def signals(papers: DataFrame, as_of: int) -> DataFrame:
    """papers (year, citation_count, most, similarity) with the signal columns; similarity below 0 counts as 0."""
    return papers.withColumns({
        "embedding": F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0))),
        "recency": scores.recency(F.col("year"), as_of),
        "citation": scores.citation(F.col("citation_count")),
        "author": scores.author(F.col("most")),
        "velocity": scores.velocity(F.col("citation_count"), F.col("year"), as_of),
    })


def ranked(scored: DataFrame, weights: scores.Weights, k: int, query: list[str], judge: str | None = None) -> DataFrame:
    """The k best rows per query with their score and rank; ties go to the smaller paper_id.

    A judge column, where not null, is blended in with weight JUDGE after clamping to 0..1. The score is not rounded
    before ranking.
    """
    s = scores.combined(weights)
    if judge:
        s = F.when(F.col(judge).isNotNull(), (1 - JUDGE) * s + JUDGE * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(judge)))).otherwise(s)
    df = scored.withColumn("score", F.round(s, 12))
    if not query:
        return df.orderBy(F.desc("score"), "paper_id").limit(k)
    w = Window.partitionBy(*query).orderBy(F.desc("score"), "paper_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(pool: DataFrame, k: int, temperature: float = TEMPERATURE) -> DataFrame:
    """(query_id, paper_id, rank): greedy maximal marginal relevance over a ranked pool (query_id, paper_id, title, score, rank).

    Each round takes the largest (1 - t) x score - t x the largest title overlap with those taken, the first on ties;
    temperature 0 keeps the order. A pool has at most POOL rows.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        sets = [set(x) for x in g["tokens"]]
        score, left, taken = g["score"].to_numpy(float), list(range(len(g))), []
        worst = np.zeros(len(g))
        while left and len(taken) < k:
            j = max(left, key=lambda i: ((1 - temperature) * score[i] - temperature * worst[i], -i))
            taken.append(j)
            left.remove(j)
            for i in left:
                u = len(sets[i] | sets[j])
                worst[i] = max(worst[i], len(sets[i] & sets[j]) / u if sets[i] and sets[j] else 0.0)
        return pd.DataFrame({"query_id": g["query_id"].iloc[taken].to_numpy(), "paper_id": g["paper_id"].iloc[taken].to_numpy(), "rank": np.arange(1, len(taken) + 1, dtype=np.int32)})

    cut = pool.where(F.col("rank") <= POOL).select("query_id", "paper_id", "score", "rank", text.title_tokens(F.col("title")).alias("tokens"))
    return cut.groupBy("query_id").applyInPandas(run, "query_id long, paper_id long, rank int")


def method_weights() -> list[tuple[str, dict[str, float]]]:
    full = scores.Weights(dict(scores.WEIGHTS))
    out = [("full", full.values)] + [(f"no_{s}", full.without(s).values) for s in ("embedding", "recency", "citation", "author")]
    only = lambda s: {k: 1.0 if k == s else 0.0 for k in scores.WEIGHTS}
    return [*out, ("citation_only", only("citation")), ("embedding_only", only("embedding"))]


def _library(spark, d: str) -> DataFrame:
    return library(*(table(spark, d, t) for t in ("part", "lineitem", "supplier")))


def pool_size(k: int) -> int:
    return max(k, MIN_POOL, POOL_FACTOR * k)


def _pool(spark, d: str, size: int = pool_size(10), keep: str | None = None) -> DataFrame:
    """Queries: vectors whose id is divisible by 50, against all rows; the paper of a vector is the part of that number.

    Of each query the `size` most similar papers of the library (those that `keep` holds for) are its pool; only pools
    are joined to the library.
    """
    e, lib = table(spark, d, "embeddings").withColumn("paper_id", (F.col("vec_id") + 1).cast("long")), _library(spark, d)
    held = lib.where(keep) if keep else lib
    q = e.where("vec_id % 50 = 0")
    sim = top_similar(e.join(held.select("paper_id"), "paper_id", "left_semi"), q, size, row_id="paper_id")
    return sim.select((F.col("q") - 1).alias("query_id"), "paper_id", F.col("score").alias("similarity")).join(lib, "paper_id")


def flagship(spark, d: str) -> DataFrame:
    """The twenty best papers of the library by recency, citations, authors and velocity."""
    df = signals(_library(spark, d).withColumn("similarity", F.lit(0.0)), AS_OF)
    return ranked(df, scores.Weights({**scores.WEIGHTS, "velocity": 0.1}), 20, []).select("paper_id", "title", *(F.round(c, 6).alias(c) for c in ("recency", "citation", "author", "velocity", "score")))


def _q_ranked(spark, d):
    df = ranked(signals(_pool(spark, d), AS_OF), scores.Weights(dict(scores.WEIGHTS)), 10, ["query_id"])
    return df.select("query_id", "paper_id", "rank", F.round("score", 6).alias("score"))


def _q_blend(spark, d):
    df = signals(_pool(spark, d), AS_OF).withColumn("judge", F.when(F.col("paper_id") % 3 == 0, (F.col("paper_id") % 7) / 5.0))
    return ranked(df, scores.Weights(dict(scores.WEIGHTS)), 10, ["query_id"], "judge").select("query_id", "paper_id", "rank", F.round("score", 6).alias("score"))


def _q_rerank(spark, d):
    df = ranked(signals(_pool(spark, d, POOL), AS_OF), scores.Weights(dict(scores.WEIGHTS)), POOL, ["query_id"])
    return rerank(df, 10)


def _q_methods(spark, d):
    """Top 10 of each query under each method, in one pass over the pools."""
    m = spark.createDataFrame([(n, *(float(w[s]) for s in scores.WEIGHTS)) for n, w in method_weights()], "method string, " + ", ".join(f"w_{s} double" for s in scores.WEIGHTS))
    df = signals(_pool(spark, d), AS_OF).crossJoin(F.broadcast(m))  # seven rows
    score = sum((F.col(f"w_{s}") * F.col(s) for s in scores.WEIGHTS), F.lit(0.0))
    w = Window.partitionBy("method", "query_id").orderBy(F.desc("score"), "paper_id")
    return df.withColumn("score", F.round(score, 12)).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("method", "query_id", "paper_id", "rank")


def _q_breakdown(spark, d):
    """What each signal contributes to the ten best papers, where above 1e-4."""
    df = flagship(spark, d).limit(10)
    parts = df.select("paper_id", *(F.round(F.col(s) * w, 6).alias(s) for s, w in {"recency": 0.20, "citation": 0.25, "author": 0.05, "velocity": 0.1}.items()))
    return parts.unpivot(["paper_id"], ["recency", "citation", "author", "velocity"], "signal", "contribution").where("contribution > 1e-4")


def _q_authors(spark, d):
    p = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return p.groupBy("l_suppkey").agg(F.count("*").alias("papers"))


def _q_filtered(spark, d):
    """The wrapped ranking: filters first, then the pool and the k best, so no over-fetching is needed."""
    df = signals(_pool(spark, d, pool_size(5), "year >= 1998 and citation_count >= 20"), AS_OF)
    return ranked(df, scores.Weights({**scores.WEIGHTS, "velocity": 0.0}), 5, ["query_id"]).select("query_id", "paper_id", "rank")


def _q_direct(spark, d):
    """A query that names a paper gets that paper first with score 1, then the others."""
    df = ranked(signals(_pool(spark, d), AS_OF), scores.Weights(dict(scores.WEIGHTS)), 10, ["query_id"]).select("query_id", "paper_id", "score")
    own = df.select("query_id").distinct().select("query_id", (F.col("query_id") + 1).alias("paper_id"), F.lit(1.0).alias("score"))
    rest = df.join(own.select("query_id", "paper_id"), ["query_id", "paper_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("src", F.desc("score"), "paper_id")
    both = own.withColumn("src", F.lit(0)).unionByName(rest.withColumn("src", F.lit(1)))
    return both.withColumn("rank", F.row_number().over(w)).select("query_id", "paper_id", "rank")


def _q_titles(spark, d):
    """Token overlap of neighbouring titles in the catalog, both ways of counting."""
    p = table(spark, d, "papers")
    w = Window.partitionBy("arxiv_id").orderBy("rec_id")
    df = p.where("arxiv_id is not null").withColumn("prev", F.lag("title").over(w))
    a, b = text.title_tokens(F.col("title")), text.title_tokens(F.col("prev"))
    return df.where("prev is not null").select("rec_id", F.round(text.jaccard(a, b), 6).alias("jaccard"), F.round(text.overlap(text.plain_words(F.col("title")), text.plain_words(F.col("prev"))), 6).alias("overlap"))


_LIB = "c AS (SELECT l_partkey AS paper_id, count(DISTINCT l_orderkey) AS cites, max(year(l_shipdate)) AS yy FROM lineitem GROUP BY 1), ap AS (SELECT DISTINCT l_partkey AS paper_id, l_suppkey AS author FROM lineitem), fr AS (SELECT author, count(*) AS f FROM ap GROUP BY 1), mo AS (SELECT paper_id, max(f) AS most FROM ap JOIN fr USING (author) GROUP BY 1), lib AS (SELECT p_partkey AS paper_id, concat_ws(' ', p_name, p_type, p_brand) AS title, cites, yy, most FROM part LEFT JOIN c ON paper_id = p_partkey LEFT JOIN mo ON mo.paper_id = p_partkey)"
_SIG = "CASE WHEN yy IS NULL THEN 0.3 ELSE pow(0.5::DOUBLE, greatest(0, 2002 - yy) / 4.0::DOUBLE) END AS recency, CASE WHEN cites IS NULL THEN 0.3 ELSE least(1, ln(1 + cites::DOUBLE) / ln(501)) END AS citation, CASE WHEN coalesce(most, 0) <= 0 THEN 0.3 ELSE least(1, ln(1 + most::DOUBLE) / ln(11)) END AS author, CASE WHEN yy IS NULL THEN 0.3 ELSE least(1, ln(1 + coalesce(cites, 0) / greatest(1, 2002 - yy)::DOUBLE) / ln(51)) END AS velocity"
def _pool_sql(size: int, keep: str = "true") -> str:
    return f"WITH {_LIB}, sm AS (SELECT q.vec_id AS query_id, e.vec_id + 1 AS paper_id, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q, embeddings e JOIN lib ON lib.paper_id = e.vec_id + 1 WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id AND {keep} QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, e.vec_id) <= {size}), s AS (SELECT query_id, sm.paper_id, greatest(0, similarity) AS embedding, yy, cites, {_SIG} FROM sm JOIN lib ON lib.paper_id = sm.paper_id), t AS (SELECT *, round(0.5::DOUBLE * embedding + 0.2::DOUBLE * recency + 0.25::DOUBLE * citation + 0.05::DOUBLE * author, 12) AS score FROM s)"


_POOLSQL = _pool_sql(30)
_TOP = " SELECT query_id, paper_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM {t}) WHERE rank <= 10"
_FLAG = f"WITH {_LIB}, s AS (SELECT *, {_SIG} FROM lib), f AS (SELECT paper_id, title, round(recency, 6) AS recency, round(citation, 6) AS citation, round(author, 6) AS author, round(velocity, 6) AS velocity, round(sc, 6) AS score, sc FROM (SELECT *, round(0.2::DOUBLE * recency + 0.25::DOUBLE * citation + 0.05::DOUBLE * author + 0.1::DOUBLE * velocity, 12) AS sc FROM s) ORDER BY sc DESC, paper_id LIMIT 20)"
_METHODS = ", ".join(f"('{n}', " + ", ".join(f"{w[s]!r}::DOUBLE" for s in ("embedding", "recency", "citation", "author")) + ")" for n, w in method_weights())
QUERIES = {
    "top10_flagship": flagship,
    "top10_ranked_pools": _q_ranked,
    "sig6_txt14_judge_blend": _q_blend,
    "top7_rerank": _q_rerank,
    "sig7_sig8_methods": _q_methods,
    "sig5_sig11_breakdown": _q_breakdown,
    "agg4_author_frequency": _q_authors,
    "top11_flt4_filtered": _q_filtered,
    "top9_direct_first": _q_direct,
    "str7_str8_title_overlap": _q_titles,
}
SQL = {
    "top10_flagship": _FLAG + " SELECT * EXCLUDE (sc) FROM f",
    "top10_ranked_pools": _POOLSQL + _TOP.format(t="t"),
    "sig6_txt14_judge_blend": _POOLSQL + ", u AS (SELECT * REPLACE (CASE WHEN paper_id % 3 = 0 THEN round(0.9::DOUBLE * score + 0.1::DOUBLE * least(1, (paper_id % 7) / 5.0::DOUBLE), 12) ELSE score END AS score) FROM t)" + _TOP.format(t="u"),
    "sig7_sig8_methods": _POOLSQL + f", m(method, we, wr, wc, wa) AS (VALUES {_METHODS}), u AS (SELECT method, query_id, paper_id, round(we * embedding + wr * recency + wc * citation + wa * author, 12) AS score FROM s, m) SELECT method, query_id, paper_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY method, query_id ORDER BY score DESC, paper_id) AS rank FROM u) WHERE rank <= 10",
    "sig5_sig11_breakdown": _FLAG + ", g AS (SELECT * FROM f ORDER BY sc DESC, paper_id LIMIT 10) SELECT * FROM (SELECT paper_id, 'recency' AS signal, round(0.2::DOUBLE * recency, 6) AS contribution FROM g UNION ALL SELECT paper_id, 'citation', round(0.25::DOUBLE * citation, 6) FROM g UNION ALL SELECT paper_id, 'author', round(0.05::DOUBLE * author, 6) FROM g UNION ALL SELECT paper_id, 'velocity', round(0.1::DOUBLE * velocity, 6) FROM g) WHERE contribution > 1e-4",
    "agg4_author_frequency": "SELECT l_suppkey, count(DISTINCT l_partkey) AS papers FROM lineitem GROUP BY 1",
    "top11_flt4_filtered": _pool_sql(20, "yy >= 1998 AND cites >= 20") + " SELECT query_id, paper_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM t) WHERE rank <= 5",
    "top9_direct_first": _POOLSQL + ", k AS (SELECT query_id, paper_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM t) WHERE rank <= 10), b AS (SELECT DISTINCT query_id, query_id + 1 AS paper_id, 1.0::DOUBLE AS score, 0 AS src FROM k UNION ALL SELECT query_id, paper_id, score, 1 FROM k WHERE paper_id <> query_id + 1) SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY src, score DESC, paper_id) AS rank FROM b",
    "str7_str8_title_overlap": f"WITH t AS (SELECT rec_id, title, lag(title) OVER (PARTITION BY arxiv_id ORDER BY rec_id) AS prev FROM papers WHERE arxiv_id IS NOT NULL), u AS (SELECT rec_id, {text.TITLE_TOKENS_SQL.format(c='title')} AS a, {text.TITLE_TOKENS_SQL.format(c='prev')} AS b, list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS c, list_distinct(list_filter(string_split(trim(regexp_replace(lower(prev), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')) AS d FROM t WHERE prev IS NOT NULL) SELECT rec_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) END AS jaccard, CASE WHEN len(c) = 0 OR len(d) = 0 THEN 0 ELSE round(len(list_intersect(c, d)) / greatest(len(c), len(d))::DOUBLE, 6) END AS overlap FROM u",
}
