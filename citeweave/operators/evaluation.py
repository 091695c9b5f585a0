"""Evaluation: retrieval metrics, rank statistics, confidence intervals, calibration, failure classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text
from citeweave.functions.skew import running
from citeweave.operators.graph import key_sql, keyed
from citeweave.operators.telemetry import percentile_at
from citeweave.session import cut, table

#: Draws of a bootstrap.
DRAWS = 2000


def metrics(expected: Column, retrieved: Column, k: int) -> dict[str, Column]:
    """Recall, reciprocal rank and hit at 1 over the first k retrieved; recall of nothing expected is 1."""
    top = F.slice(retrieved, 1, k)
    found = F.size(F.array_intersect(expected, top))
    first = F.aggregate(top, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")), lambda s, x: F.struct((s["i"] + 1).alias("i"), F.when((s["at"] == 0) & F.array_contains(expected, x), s["i"] + 1).otherwise(s["at"]).alias("at")), lambda s: s["at"])
    return {
        "recall": F.when(F.size(expected) == 0, F.lit(1.0)).otherwise((found > 0).cast("double")),
        "rr": F.when(first > 0, 1.0 / first).otherwise(F.lit(0.0)),
        "hit1": (first == 1).cast("double"),
    }


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """df with the rank of value, largest first, ties sharing their mean rank.

    Ranks come from counts per value, run through in parts, and are joined back, so that a group is in no one task.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranks = running(counts, by, [F.desc(value)], F.col("_c"), "_lo").select(*by, value, (F.col("_lo") + (F.col("_c") + 1) / 2.0).alias(out))
    return df.join(ranks, [*by, value])


def correlation(a: str, b: str, least: int = 2) -> Column:
    """Pearson correlation of two columns as an aggregate; null below `least` rows or where either does not vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count("*") >= least) & (spread > 0), F.covar_pop(a, b) / spread)


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, rho): the correlation of average ranks; null below two rows or where either does not vary."""
    r = average_ranks(average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), by, a, "_ra"), by, b, "_rb")
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.round(correlation("_ra", "_rb"), 6).alias("rho"))


def ndcg(df: DataFrame, by: list[str], relevance: str, order: list[Column], k: int) -> DataFrame:
    """(by, ndcg): gain 2^rel - 1, discount log2(rank + 1), over the first k; 0 where nothing is relevant."""
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    disc = lambda r: F.log2(F.col(r) + 1.0)
    real = Window.partitionBy(*by).orderBy(*order)
    best = Window.partitionBy(*by).orderBy(F.desc(relevance), *order)
    top = lambda w, ideal: df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).withColumn("_i", F.lit(ideal))  # noqa: E731  # k rows of each task
    r = top(real, False).unionByName(top(best, True))
    dcg = F.sum(F.when(~F.col("_i"), gain / disc("_r")))
    ideal = F.sum(F.when(F.col("_i"), gain / disc("_r")))
    return r.groupBy(*by).agg(F.round(F.when(ideal > 0, dcg / ideal).otherwise(0.0), 6).alias("ndcg"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, within 0 and 1; (0, 0) for n = 0."""
    p = k / F.greatest(n, F.lit(1))
    d = 1 + z * z / F.greatest(n, F.lit(1))
    mid = (p + z * z / (2 * F.greatest(n, F.lit(1)))) / d
    half = z * F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1)) + z * z / (4 * F.greatest(n, F.lit(1)) * F.greatest(n, F.lit(1)))) / d
    zero = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(F.round(c, 6))
    return zero(F.greatest(F.lit(0.0), mid - half)), zero(F.least(F.lit(1.0), mid + half))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts; 1 where there are none."""
    n = b + c
    log_fact = lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(x, F.lit(1))), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    low = F.least(b, c)
    term = F.aggregate(F.sequence(F.lit(0), low.cast("int")), F.lit(0.0), lambda s, i: s + F.exp(log_fact(n.cast("int")) - log_fact(i) - log_fact(n.cast("int") - i) - n * F.log(F.lit(2.0))))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * term))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers from 64-bit numbers."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def bootstrap_mean(df: DataFrame, by: list[str], row_id: str, value: str, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """(by, n, mean, lo, hi, p): percentile interval of the mean and two-sided p of its sign, by Poisson bootstrap.

    Each row's weight in each draw is Poisson(1), from a hash of row and draw, so results do not depend on the layout.
    A task sums its rows' weights of all draws; the shuffle holds one row per task, group and draw. Null values are left
    out; a draw that takes no row of a group is left out. p is twice the smaller share of means on either side of 0.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.xxhash64(row_id, F.lit(seed)).alias("_h"))
    kinds = dict(rows.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "_b int, _s double, _w double"
    quantiles = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(12)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        steps = _mixed(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for b in batches:
            for key, g in b.groupby(by, dropna=False) if by else [((), b)]:
                key = key if isinstance(key, tuple) else (key,)
                total = sums.setdefault(key, np.zeros((2, draws)))
                for at in range(0, len(g), 500):
                    h, v = g["_h"].to_numpy()[at : at + 500].astype(np.uint64), g["_v"].to_numpy()[at : at + 500]
                    u = (_mixed(h[:, None] + steps[None, :]) >> np.uint64(11)) / float(2**53)
                    w = np.searchsorted(quantiles, u, side="right").astype(float)
                    total += np.stack([v @ w, w.sum(0)])
        for key, (s, w) in sums.items():
            yield pd.DataFrame({**{c: [x] * draws for c, x in zip(by, key)}, "_b": np.arange(draws, dtype=np.int32), "_s": s, "_w": w})

    drawn = rows.mapInPandas(run, schema).groupBy(*by, "_b").agg(F.sum("_s").alias("_s"), F.sum("_w").alias("_w")).where("_w > 0")
    means = drawn.groupBy(*by).agg(F.array_sort(F.collect_list(F.round(F.col("_s") / F.col("_w"), 12))).alias("_m"))  # `draws` numbers
    at = lambda q: F.element_at("_m", F.greatest(F.lit(1), F.ceil(F.size("_m") * q)).cast("int"))
    side = lambda test: F.size(F.filter("_m", test)) / F.size("_m")
    p = F.least(F.lit(1.0), 2 * F.least(side(lambda x: x <= 0), side(lambda x: x >= 0)))
    point = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    both = point.join(means, by) if by else point.crossJoin(means)  # one row each
    return both.select(*by, "n", "mean", at(0.025).alias("lo"), at(0.975).alias("hi"), p.alias("p"))


def _answers(spark, d: str) -> DataFrame:
    """Evaluation rows: refused and answered flags, a top score and a recall made of the coverage label."""
    a = table(spark, d, "d_oos_full_answers")
    score = F.when(F.col("coverage") == "high", 0.8).when(F.col("coverage") == "partial", 0.6).when(F.col("coverage") == "low", 0.4).otherwise(0.0) + (F.col("qa_id") % 10) / 997.0
    return a.select("qa_id", "id", "kind", "coverage", "should_refuse", "answer_full", "n_references", "latency_ms", text.refuses(F.col("answer_full")).alias("refused"), text.refuses(F.col("answer_full"), True).alias("refused_broad"), score.alias("top_score"), (F.coalesce("n_references", F.lit(0)) >= 3).cast("double").alias("hit"))


def _retrieved(spark, d: str) -> DataFrame:
    """Per paper: its references (expected) and what it cites in the edge table, by date (retrieved)."""
    r = keyed(table(spark, d, "ref_edges").select("focal_id", "ref_id"), "focal_id", "ref_id").where("ref_id is not null").groupBy("focal_id").agg(F.array_sort(F.collect_set("ref_id")).alias("expected"))
    e = keyed(table(spark, d, "edges").select("citer_id", "cited_id", "fetch_date", "row_id"), "citer_id", "cited_id").where("citer_id is not null and cited_id is not null")
    first = e.groupBy("citer_id", "cited_id").agg(F.min(F.struct(F.coalesce(F.unix_micros("fetch_date"), F.lit(2**62)), "row_id")).alias("at"))
    lists = first.groupBy(F.col("citer_id").alias("focal_id")).agg(F.array_sort(F.collect_list(F.struct("at", "cited_id"))).alias("l"))
    return r.join(lists, "focal_id", "left").select("focal_id", "expected", F.coalesce(F.transform("l", lambda x: x["cited_id"]), F.array().cast("array<string>")).alias("retrieved"))


def _q_metrics(spark, d):
    return _retrieved(spark, d).select("focal_id", F.size("expected").cast("long").alias("n_expected"), *(F.round(c, 6).alias(k) for k, c in metrics(F.col("expected"), F.col("retrieved"), 6).items()))


def _q_summary(spark, d):
    m = _retrieved(spark, d).select("focal_id", *(c.alias(k) for k, c in metrics(F.col("expected"), F.col("retrieved"), 6).items()))
    return m.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "rr", "hit1")))


def _q_missing(spark, d):
    """Expected papers that were not retrieved, by how many questions they cost."""
    miss = _retrieved(spark, d).select(F.explode(F.array_except("expected", "retrieved")).alias("missing"))
    return miss.groupBy("missing").agg(F.count("*").alias("questions"))


def _q_lift(spark, d):
    """What the mean recall over the first 6 would gain if a missing paper were found; papers that miss at least 2 questions."""
    m = _retrieved(spark, d)
    n = m.agg(F.count("*").alias("n"))
    lost = m.where(F.size(F.array_intersect("expected", F.slice("retrieved", 1, 6))) == 0).select(F.explode("expected").alias("paper"))
    return lost.groupBy("paper").agg(F.count("*").alias("gained")).where("gained >= 2").crossJoin(n).select("paper", "gained", F.round(F.col("gained") / F.col("n"), 6).alias("lift"))  # one row


def _q_presence(spark, d):
    """Expected papers without a passage, or with fewer than five."""
    docs = keyed(table(spark, d, "documents").select("canonical_id"), "canonical_id").groupBy(F.col("canonical_id").alias("ref_id")).agg(F.count("*").alias("n"))
    refs = keyed(table(spark, d, "ref_edges").select("ref_id"), "ref_id").where("ref_id is not null").distinct()
    n = F.coalesce("n", F.lit(0))
    return refs.join(docs, "ref_id", "left").groupBy(F.when(n == 0, "missing").when(n < 5, "low").otherwise("present").alias("presence")).agg(F.count("*").alias("papers"))


def _q_strata(spark, d):
    """Means by kind, by coverage, by both and over all, in one pass."""
    a = _answers(spark, d).withColumns({"kind": F.coalesce("kind", F.lit("unknown")), "coverage": F.coalesce("coverage", F.lit("?"))})
    g = a.groupingSets([["kind"], ["coverage"], ["kind", "coverage"], []], "kind", "coverage")
    return g.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("top_score"), 6).alias("top_score"))


def _q_calibration(spark, d):
    a = _answers(spark, d)
    return a.groupBy(F.coalesce("coverage", F.lit("none")).alias("coverage")).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit"))


def _q_quintiles(spark, d):
    """Rows by top score in five parts cut at floor(i x n / 5); positions are counted in parts."""
    a = _answers(spark, d).select("top_score", "qa_id", "hit")
    pos = running(a, [], [F.col("top_score"), F.col("qa_id")], F.lit(1), "pos").crossJoin(F.broadcast(a.agg(F.count("*").alias("n"))))  # one row
    bucket = sum(((F.col("pos") >= F.floor(F.col("n") * i / 5)).cast("int") for i in range(1, 5)), F.lit(1))
    return pos.groupBy(bucket.alias("part")).agg(F.count("*").alias("rows"), F.round(F.min("top_score"), 6).alias("lo"), F.round(F.max("top_score"), 6).alias("hi"), F.round(F.avg("hit"), 6).alias("hit"))


def _q_confusion(spark, d):
    a = _answers(spark, d).where("should_refuse is not null").select("should_refuse", F.explode(F.array(F.struct(F.lit("official").alias("grader"), F.col("refused").alias("r")), F.struct(F.lit("broader").alias("grader"), F.col("refused_broad").alias("r")))).alias("g"))
    s, r = F.col("should_refuse"), F.col("g.r")
    c = a.groupBy("g.grader").agg(F.count_if(s & r).alias("tp"), F.count_if(~s & r).alias("fp"), F.count_if(~s & ~r).alias("tn"), F.count_if(s & ~r).alias("fn"))
    div = lambda x, y: F.when(y > 0, F.round(x / y, 6)).otherwise(0.0)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select("grader", "tp", "fp", "tn", "fn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def _q_hints(spark, d):
    """The class of failure of each answer."""
    a = _answers(spark, d)
    hint = F.when(F.col("should_refuse") & ~F.col("refused"), "false_answer").when(~F.col("should_refuse") & F.col("refused"), "over_refuse").when(~F.col("should_refuse") & (F.col("hit") == 0) & (F.col("top_score") < 0.55), "missing_or_ranking").when(~F.col("should_refuse") & (F.col("hit") == 0), "ranking").otherwise("none")
    g = a.groupBy(hint.alias("hint")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # five rows


def _q_wilson(spark, d):
    g = _answers(spark, d).groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count_if(F.col("hit") == 1).alias("k"), F.count("*").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select("kind", "k", "n", lo.alias("lo"), hi.alias("hi"))


def _q_mcnemar(spark, d):
    """Official against broader refusal grader, per kind: who is right where they differ."""
    a = _answers(spark, d).where("should_refuse is not null and kind is not null")
    x, y = F.col("refused") == F.col("should_refuse"), F.col("refused_broad") == F.col("should_refuse")
    g = a.groupBy("kind").agg(F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"))
    return g.select("kind", "b", "c", F.round(mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


def _q_citations(spark, d):
    a = table(spark, d, "d_oos_full_answers")
    c = text.cited_numbers(F.col("answer_full"))
    return a.select("qa_id", F.size(c).cast("long").alias("n_citations"), text.citations_valid(F.col("answer_full"), F.col("n_references")).alias("valid"), text.refuses(F.col("answer_full")).alias("official"), text.refuses(F.col("answer_full"), True).alias("broader"))


def grounded(answers: DataFrame, sources: DataFrame, row_id: str, answer: str, number: str, source: str) -> DataFrame:
    """(row_id, n_sentences, n_cited, n_grounded, citation_precision, groundedness_ratio) of each answer against the passages it cites.

    sources holds (row_id, number, source): the text that [number] stands for, unique per row_id and number. Sentences
    have more than 10 characters. A tag is supported if its source shares at least min(3, words) words of three or more
    letters or digits with the sentence; a sentence is grounded if one of its tags is. Without tags, ratios are 1 for a
    refusal and 0 otherwise; so they are for an answer without sentences, null ones among them.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), 0))
    base = answers.select(F.col(row_id).alias("_i"), F.coalesce(F.col(answer), F.lit("")).alias("_a"))
    parts = base.select("_i", F.posexplode(F.filter(F.transform(F.split("_a", r"(?<=[.!?])\s+"), F.trim), lambda s: F.length(s) > 10)).alias("_p", "_s"))
    tags = parts.select("_i", "_p", words(F.col("_s")).alias("_w"), F.explode(text.cited_numbers(F.col("_s"))).alias("_n"))
    given = sources.select(F.col(row_id).alias("_i"), F.col(number).alias("_n"), words(F.col(source)).alias("_c"))
    held = tags.join(given, ["_i", "_n"], "left")
    ok = F.coalesce(F.size(F.array_intersect("_w", "_c")) >= F.least(F.lit(3), F.greatest(F.lit(1), F.size("_w"))), F.lit(False))
    per = held.groupBy("_i", "_p").agg(F.count("*").alias("_t"), F.count_if(ok).alias("_k")).groupBy("_i").agg(F.sum("_t").alias("_t"), F.sum("_k").alias("_k"), F.count("*").alias("n_cited"), F.count_if(F.col("_k") > 0).alias("n_grounded"))
    n = parts.groupBy("_i").agg(F.count("*").alias("n_sentences"))
    every = base.join(n, "_i", "left").join(per, "_i", "left")
    none = text.refuses(F.col("_a")).cast("double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = lambda a, b: F.round(F.when(F.coalesce(b, F.lit(0)) > 0, a / b).otherwise(none), 4)
    return every.select(F.col("_i").alias(row_id), zero("n_sentences"), zero("n_cited"), zero("n_grounded"), share(F.col("_k"), F.col("_t")).alias("citation_precision"), share(F.col("n_grounded"), F.col("n_cited")).alias("groundedness_ratio"))


def _q_grounded(spark, d):
    """Answers against what they cite: source [n] of an answer, up to its n_references, is the document of id (qa_id + n) mod all + 1."""
    a, docs = table(spark, d, "d_oos_full_answers"), table(spark, d, "documents").select("doc_id", "text")
    count = docs.agg(F.count("*").alias("_n"))
    cited = F.array_distinct(F.filter(text.cited_numbers(F.col("answer_full")), lambda x: (x >= 1) & (x <= F.coalesce("n_references", F.lit(0)))))
    named = a.select("qa_id", F.explode(cited).alias("number")).crossJoin(F.broadcast(count))  # one row
    given = named.withColumn("doc_id", (F.col("qa_id") + F.col("number")) % F.col("_n") + 1).join(docs, "doc_id")
    return grounded(a, given, "qa_id", "answer_full", "number", "text")


def _labelled(spark, d: str) -> DataFrame:
    """Catalog records with a made relevance label per source: how much of the abstract is there, 1 to 5."""
    p = table(spark, d, "papers").where("citation_count is not null and year is not null")
    rel = 1 + F.least(F.lit(4), F.floor(F.length(F.coalesce("abstract", F.lit(""))) / 200)).cast("int")
    return p.select("rec_id", F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("src"), "citation_count", "year", rel.alias("rel"))


def _q_spearman(spark, d):
    return spearman(_labelled(spark, d), ["src"], "rel", "citation_count")


def _q_ndcg(spark, d):
    return ndcg(_labelled(spark, d), ["src"], "rel", [F.desc("citation_count"), F.col("rec_id")], 10)


def _q_gaps(spark, d):
    """Per source, the five records ranked furthest below and above their label."""
    r = average_ranks(average_ranks(_labelled(spark, d), ["src"], "rel", "label_rank"), ["src"], "citation_count", "system_rank").withColumn("gap", F.col("system_rank") - F.col("label_rank"))
    r = cut(r.select("src", "rec_id", "gap"))
    first = lambda *o: r.withColumn("u", F.row_number().over(Window.partitionBy("src").orderBy(*o))).where("u <= 5")  # noqa: E731  # five rows of each task
    return first("gap", "rec_id").unionByName(first(F.desc("gap"), "rec_id")).select("src", "rec_id", F.round("gap", 6).alias("gap")).distinct()


def _q_labels(spark, d):
    return _labelled(spark, d).groupBy("rel").agg(F.count("*").alias("n"), F.count_if(F.col("rel") >= 4).alias("high"))


def _q_gate(spark, d):
    """Thresholds on quality and latency and whether all hold."""
    rows = _answers(spark, d)
    at = 0.95 * (F.col("n") - 1)
    p95 = percentile_at(rows, "latency_ms", {"lo": F.floor(at), "hi": F.ceil(at)})
    n = rows.agg(F.count("latency_ms").alias("n"))
    a = rows.agg(F.avg("hit").alias("hit"), F.avg((F.col("refused") == F.col("should_refuse")).cast("double")).alias("refusal_accuracy")).crossJoin(p95).crossJoin(n)  # one row each
    a = a.withColumn("p95", F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at)))
    g = a.select((F.col("hit") >= 0.5).alias("hit_ok"), (F.col("refusal_accuracy") >= 0.6).alias("refusal_ok"), (F.col("p95") <= 15000).alias("latency_ok"))
    return g.withColumn("all_ok", F.col("hit_ok") & F.col("refusal_ok") & F.col("latency_ok"))


def _q_baseline(spark, d):
    """Per source: spread and correlation of citation counts with year, null below five rows."""
    p = _labelled(spark, d)
    return p.groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("citation_count"), 6).alias("mean"), F.round(F.stddev_pop("citation_count"), 6).alias("sd"), F.min("citation_count").alias("lo"), F.max("citation_count").alias("hi"), F.round(correlation("year", "citation_count", 5), 6).alias("r"))


def _q_histogram(spark, d):
    p = table(spark, d, "papers").where("citation_count >= 0")
    return p.groupBy(F.least(F.lit(20), F.floor(F.log2(F.col("citation_count") + 1.0))).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def _q_bootstrap(spark, d):
    a = _answers(spark, d).withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    return bootstrap_mean(a, ["kind"], "qa_id", "hit").drop("p")


def _q_cluster_bootstrap(spark, d):
    """Means per question id first, then their bootstrap."""
    a = _answers(spark, d).where("id is not null").groupBy("id", F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.avg("hit").alias("hit"))
    return bootstrap_mean(a, ["kind"], "id", "hit").drop("p")


def _q_paired(spark, d):
    """Difference of the two refusal graders' accuracy, with its interval."""
    a = _answers(spark, d).where("should_refuse is not null").withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    diff = (F.col("refused_broad") == F.col("should_refuse")).cast("int") - (F.col("refused") == F.col("should_refuse")).cast("int")
    return bootstrap_mean(a.withColumn("diff", diff.cast("double")), ["kind"], "qa_id", "diff")


_OFF, _BRO = text.any_sql("lower(coalesce(answer_full, ''))", text.REFUSALS), text.any_sql("lower(coalesce(answer_full, ''))", text.REFUSALS_BROADER)
_A = f"a AS (SELECT qa_id, id, coverage, kind, should_refuse, latency_ms, {_OFF} AS refused, {_BRO} AS refused_broad, CASE coverage WHEN 'high' THEN 0.8::DOUBLE WHEN 'partial' THEN 0.6::DOUBLE WHEN 'low' THEN 0.4::DOUBLE ELSE 0 END + (qa_id % 10) / 997.0::DOUBLE AS top_score, (coalesce(n_references, 0) >= 3)::INT::DOUBLE AS hit FROM d_oos_full_answers)"
_R = f"""r AS (SELECT focal_id, list(DISTINCT ref_id) AS expected FROM (SELECT {key_sql('focal_id')} AS focal_id, {key_sql('ref_id')} AS ref_id FROM ref_edges) WHERE ref_id IS NOT NULL AND focal_id IS NOT NULL GROUP BY 1),
e AS (SELECT citer_id, cited_id, coalesce(epoch_us(fetch_date), 4611686018427387904) AS ts, row_id FROM (SELECT {key_sql('citer_id')} AS citer_id, {key_sql('cited_id')} AS cited_id, fetch_date, row_id FROM edges) WHERE citer_id IS NOT NULL AND cited_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY citer_id, cited_id ORDER BY ts, row_id) = 1),
l AS (SELECT citer_id, list(cited_id ORDER BY ts, row_id) AS retrieved FROM e GROUP BY 1), m AS (SELECT focal_id, expected, coalesce(retrieved, []) AS retrieved FROM r LEFT JOIN l ON citer_id = focal_id),
x AS (SELECT focal_id, len(expected) AS n_expected, (len(list_intersect(expected, retrieved[:6])) > 0)::INT::DOUBLE AS recall, list_position(list_transform(retrieved[:6], lambda x: list_contains(expected, x)), true) AS first FROM m),
y AS (SELECT focal_id, n_expected, recall, CASE WHEN coalesce(first, 0) > 0 THEN 1.0::DOUBLE / first ELSE 0 END AS rr, CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0 END AS hit1 FROM x)"""
_L = "p AS (SELECT rec_id, coalesce(lower(trim(source)), 'none') AS src, citation_count, year, 1 + least(4, length(coalesce(abstract, '')) // 200)::INT AS rel FROM papers WHERE citation_count IS NOT NULL AND year IS NOT NULL)"
_RANKS = "k AS (SELECT *, rank() OVER (PARTITION BY src ORDER BY rel DESC) + (count(*) OVER (PARTITION BY src, rel) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY src ORDER BY citation_count DESC) + (count(*) OVER (PARTITION BY src, citation_count) - 1) / 2.0::DOUBLE AS rb FROM p)"
QUERIES = {
    "evl1_evl3_metrics": _q_metrics,
    "agg13_summary": _q_summary,
    "agg17_missing_papers": _q_missing,
    "agg19_ingest_lift": _q_lift,
    "jn11_presence": _q_presence,
    "agg14_strata": _q_strata,
    "agg15_calibration": _q_calibration,
    "agg16_quintiles": _q_quintiles,
    "agg18_confusion": _q_confusion,
    "evl15_agg20_failure_hints": _q_hints,
    "evl9_wilson": _q_wilson,
    "evl10_mcnemar": _q_mcnemar,
    "evl12_evl13_citations": _q_citations,
    "evl14_groundedness": _q_grounded,
    "evl4_win3_spearman": _q_spearman,
    "evl5_ndcg": _q_ndcg,
    "win4_rank_gaps": _q_gaps,
    "agg29_label_counts": _q_labels,
    "agg27_gate": _q_gate,
    "agg23_baseline_report": _q_baseline,
    "agg26_histogram": _q_histogram,
    "evl7_bootstrap": _q_bootstrap,
    "evl8_cluster_bootstrap": _q_cluster_bootstrap,
    "evl11_paired_bootstrap": _q_paired,
}
_TT = text.TITLE_TOKENS_SQL
SQL = {
    "evl1_evl3_metrics": f"WITH {_R} SELECT focal_id, n_expected, recall, round(rr, 6) AS rr, hit1 FROM y",
    "agg13_summary": f"WITH {_R} SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(hit1), 6) AS hit1 FROM y",
    "agg17_missing_papers": f"WITH {_R} SELECT missing, count(*) AS questions FROM (SELECT unnest(list_filter(expected, lambda x: NOT list_contains(retrieved, x))) AS missing FROM m) GROUP BY 1",
    "agg19_ingest_lift": f"WITH {_R}, z AS (SELECT unnest(expected) AS paper FROM m WHERE len(list_intersect(expected, retrieved[:6])) = 0) SELECT paper, count(*) AS gained, round(count(*) / (SELECT count(*) FROM m)::DOUBLE, 6) AS lift FROM z GROUP BY 1 HAVING count(*) >= 2",
    "jn11_presence": f"WITH d AS (SELECT {key_sql('canonical_id')} AS ref_id, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT DISTINCT {key_sql('ref_id')} AS ref_id FROM ref_edges) SELECT CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < 5 THEN 'low' ELSE 'present' END AS presence, count(*) AS papers FROM r LEFT JOIN d ON r.ref_id = d.ref_id WHERE r.ref_id IS NOT NULL GROUP BY 1",
    "agg14_strata": f"WITH {_A}, b AS (SELECT coalesce(kind, 'unknown') AS kind, coalesce(coverage, '?') AS coverage, hit, top_score FROM a) SELECT kind, coverage, grouping(kind, coverage)::BIGINT AS level, count(*) AS n, round(avg(hit), 6) AS hit, round(avg(top_score), 6) AS top_score FROM b GROUP BY GROUPING SETS ((kind), (coverage), (kind, coverage), ())",
    "agg15_calibration": f"WITH {_A} SELECT coalesce(coverage, 'none') AS coverage, count(*) AS n, round(avg(hit), 6) AS hit FROM a GROUP BY 1",
    "agg16_quintiles": f"WITH {_A}, b AS (SELECT *, row_number() OVER (ORDER BY top_score, qa_id) - 1 AS pos, count(*) OVER () AS n FROM a) SELECT 1 + (pos >= n // 5)::INT + (pos >= 2 * n // 5)::INT + (pos >= 3 * n // 5)::INT + (pos >= 4 * n // 5)::INT AS part, count(*) AS rows, round(min(top_score), 6) AS lo, round(max(top_score), 6) AS hi, round(avg(hit), 6) AS hit FROM b GROUP BY 1",
    "agg18_confusion": f"WITH {_A}, b AS (SELECT 'official' AS grader, should_refuse AS s, refused AS r FROM a UNION ALL SELECT 'broader', should_refuse, refused_broad FROM a), c AS (SELECT grader, count(*) FILTER (s AND r) AS tp, count(*) FILTER (NOT s AND r) AS fp, count(*) FILTER (NOT s AND NOT r) AS tn, count(*) FILTER (s AND NOT r) AS fn FROM b WHERE s IS NOT NULL GROUP BY 1) SELECT grader, tp, fp, tn, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 6) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 6) ELSE 0 END AS recall, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy FROM c",
    "evl15_agg20_failure_hints": f"WITH {_A}, b AS (SELECT CASE WHEN should_refuse AND NOT refused THEN 'false_answer' WHEN NOT should_refuse AND refused THEN 'over_refuse' WHEN NOT should_refuse AND hit = 0 AND top_score < 0.55 THEN 'missing_or_ranking' WHEN NOT should_refuse AND hit = 0 THEN 'ranking' ELSE 'none' END AS hint FROM a) SELECT hint, count(*) AS n, round(count(*) / (SELECT count(*) FROM b)::DOUBLE, 6) AS share FROM b GROUP BY 1",
    "evl9_wilson": f"WITH {_A}, g AS (SELECT coalesce(kind, 'unknown') AS kind, count(*) FILTER (hit = 1) AS k, count(*) AS n FROM a GROUP BY 1), h AS (SELECT *, k / n::DOUBLE AS p, 1 + 3.8416::DOUBLE / n AS d FROM g) SELECT kind, k, n, round(greatest(0, (p + 3.8416::DOUBLE / (2 * n)) / d - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / d), 6) AS lo, round(least(1, (p + 3.8416::DOUBLE / (2 * n)) / d + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / d), 6) AS hi FROM h",
    "evl10_mcnemar": f"WITH {_A}, g AS (SELECT kind, count(*) FILTER ((refused = should_refuse) AND (refused_broad <> should_refuse)) AS b, count(*) FILTER ((refused <> should_refuse) AND (refused_broad = should_refuse)) AS c FROM a WHERE should_refuse IS NOT NULL AND kind IS NOT NULL GROUP BY 1), t AS (SELECT kind, sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) AS s FROM (SELECT *, unnest(range(0, least(b, c) + 1)) AS i FROM g) GROUP BY 1) SELECT kind, b, c, CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE round(least(1, 2 * s), 6) END AS p FROM g JOIN t USING (kind)",
    "evl12_evl13_citations": f"WITH c AS (SELECT *, list_transform(regexp_extract_all(coalesce(answer_full, ''), '\\[(\\d{{1,9}})\\]', 1), lambda x: x::INT) AS l FROM d_oos_full_answers) SELECT qa_id, len(l) AS n_citations, CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: x < 1 OR x > coalesce(n_references, 0))) = 0 ELSE coalesce(n_references, 0) = 0 OR {_OFF} END AS valid, {_OFF} AS official, {_BRO} AS broader FROM c",
    "evl14_groundedness": f"""WITH a AS (SELECT qa_id, coalesce(answer_full, '') AS t, coalesce(n_references, 0) AS n FROM d_oos_full_answers),
p AS (SELECT qa_id, n, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM (SELECT qa_id, n, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10) AS l FROM a)),
g AS (SELECT qa_id, n, p, list_distinct(regexp_extract_all(lower(s), '[a-z0-9]{{3,}}')) AS w, unnest(list_transform(regexp_extract_all(s, '\\[(\\d{{1,9}})\\]', 1), lambda x: x::INT)) AS k FROM p),
h AS (SELECT g.*, coalesce(len(list_intersect(w, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]{{3,}}')))) >= least(3, greatest(1, len(w))), false) AS ok FROM g LEFT JOIN documents d ON k BETWEEN 1 AND n AND d.doc_id = (qa_id + k) % (SELECT count(*) FROM documents) + 1),
q AS (SELECT qa_id, sum(t)::BIGINT AS t, sum(s)::BIGINT AS s, count(*) AS c, count(*) FILTER (s > 0) AS g FROM (SELECT qa_id, p, count(*) AS t, count(*) FILTER (ok) AS s FROM h GROUP BY 1, 2) GROUP BY 1), m AS (SELECT qa_id, count(*) AS m FROM p GROUP BY 1)
SELECT z.qa_id, coalesce(m, 0) AS n_sentences, coalesce(c, 0) AS n_cited, coalesce(g, 0) AS n_grounded, CASE WHEN coalesce(t, 0) > 0 THEN round(s / t::DOUBLE, 4) ELSE {_OFF}::INT::DOUBLE END AS citation_precision, CASE WHEN coalesce(c, 0) > 0 THEN round(g / c::DOUBLE, 4) ELSE {_OFF}::INT::DOUBLE END AS groundedness_ratio
FROM d_oos_full_answers z LEFT JOIN m USING (qa_id) LEFT JOIN q USING (qa_id)""",
    "evl4_win3_spearman": f"WITH {_L}, {_RANKS} SELECT src, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 6) END AS rho FROM k GROUP BY 1",
    "evl5_ndcg": f"WITH {_L}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY citation_count DESC, rec_id) AS r, row_number() OVER (PARTITION BY src ORDER BY rel DESC, citation_count DESC, rec_id) AS b FROM p) SELECT src, round(sum((pow(2, rel) - 1) / log2(r + 1)) FILTER (r <= 10) / sum((pow(2, rel) - 1) / log2(b + 1)) FILTER (b <= 10), 6) AS ndcg FROM k GROUP BY 1",
    "win4_rank_gaps": f"WITH {_L}, {_RANKS}, g AS (SELECT src, rec_id, rb - ra AS gap, row_number() OVER (PARTITION BY src ORDER BY rb - ra, rec_id) AS u, row_number() OVER (PARTITION BY src ORDER BY rb - ra DESC, rec_id) AS v FROM k) SELECT src, rec_id, round(gap, 6) AS gap FROM g WHERE u <= 5 OR v <= 5",
    "agg29_label_counts": f"WITH {_L} SELECT rel, count(*) AS n, count(*) FILTER (rel >= 4) AS high FROM p GROUP BY 1",
    "agg27_gate": f"WITH {_A}, g AS (SELECT avg(hit) >= 0.5 AS hit_ok, avg((refused = should_refuse)::INT) >= 0.6 AS refusal_ok, quantile_cont(latency_ms, 0.95) <= 15000 AS latency_ok FROM a) SELECT *, hit_ok AND refusal_ok AND latency_ok AS all_ok FROM g",
    "agg23_baseline_report": f"WITH {_L} SELECT src, count(*) AS n, round(avg(citation_count), 6) AS mean, round(stddev_pop(citation_count), 6) AS sd, min(citation_count) AS lo, max(citation_count) AS hi, CASE WHEN count(*) >= 5 AND stddev_pop(year) > 0 AND stddev_pop(citation_count) > 0 THEN round(corr(year, citation_count), 6) END AS r FROM p GROUP BY 1",
    "agg26_histogram": "SELECT least(20, floor(log2(citation_count + 1)))::BIGINT AS bin, count(*) AS n FROM papers WHERE citation_count >= 0 GROUP BY 1",
}
