"""Library upkeep and lookups: availability, candidates, id unions, budgets, vector top-k, curation, labels and dates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import scores, text, vectors
from citeweave.functions.ids import arxiv_id
from citeweave.operators import catalog, evaluation, geometry, impact, retrieval
from citeweave.operators.dense import top_similar
from citeweave.operators.graph import catalog_nodes, key_sql, keyed
from citeweave.operators.impact import months_between, parsed_date
from citeweave.plans import pipelines
from citeweave.session import cut, table


def sanitised(df: DataFrame) -> DataFrame:
    """df with NaN and infinite numbers null, in columns and in arrays of numbers."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    fix = {}
    for c, t in df.dtypes:
        if t in ("double", "float"):
            fix[c] = F.when(~bad(F.col(c)), F.col(c))
        elif t in ("array<double>", "array<float>"):
            fix[c] = F.transform(c, lambda x: F.when(~bad(x), x))
    return df.withColumns(fix) if fix else df


def nearest_rows(vecs: DataFrame, asked: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """(q, vec_id, score, rank): the k rows most similar to each of a stated set of queries; ties to the smaller id.

    score is the dot product of unit vectors, at least 0. The `same` column must be equal.
    """
    return top_similar(vecs, asked, k, same=same, least=0.0).select("q", "vec_id", "score", "rank")


def budgeted(items: DataFrame, order: list[Column], cost_s: float, cost_mb: float, limit_s: float, limit_mb: float, most: int) -> DataFrame:
    """The first items in order that fit a budget of time, space and number, at constant cost each."""
    return items.orderBy(*order).limit(int(min(limit_s // cost_s, limit_mb // cost_mb, most)))


def curated(papers: DataFrame, by: str, order: list[Column], relevance: Column | None = None, pool: int = 200, target: int = 20, threshold: float = 0.88, strong: float = 0.25, enough: int = 40) -> DataFrame:
    """(by, rec_id, place): of each group (text column `by`), `target` papers in order that skip titles near-equal to one taken; skipped ones fill up where too few are left.

    order are numbers, the largest first, nulls as 0; ties go to the smaller rec_id. With relevance, groups with at least
    max(enough, target / 2) papers of relevance `strong` choose among those alone. A round looks at the next `pool` papers
    that are near no paper taken so far, and groups that are still short have another round, so every paper has its
    turn; at most `target` rounds are needed. Null groups, and empty tables, give no rows; titles without words are near nothing.
    """
    rank = F.struct(*((-F.coalesce(c.cast("double"), F.lit(0.0))).alias(f"o{i}") for i, c in enumerate(order)), F.col("rec_id"))
    fit = F.coalesce(relevance >= strong, F.lit(False)) if relevance is not None else F.lit(True)
    p = cut(papers.where(F.col(by).isNotNull()).select(F.col(by).alias("g"), "rec_id", rank.alias("o"), text.plain_words(F.col("title")).alias("w"), fit.alias("fit")))
    sizes = p.groupBy("g").agg(F.count("*").alias("rows"), F.count_if("fit").alias("fits"))
    sizes = sizes.withColumn("only", F.col("fits") >= max(enough, target // 2)).select("g", "only", F.when(F.col("only"), F.col("fits")).otherwise(F.col("rows")).alias("rows"))
    p = p.join(sizes, "g").where(~F.col("only") | F.col("fit")).select("g", "rec_id", "o", "w", "rows")

    def take(g: pd.DataFrame, taken: pd.DataFrame) -> pd.DataFrame:
        g, sets = g.sort_values("rn"), [set(x) for x in taken["w"]]
        some = []
        for i, s in enumerate(map(set, g["w"])):
            if len(sets) >= target:
                break
            if not any(s and t and len(s & t) / max(len(s), len(t)) >= threshold for t in sets):
                sets.append(s)
                some.append(i)
        out = g.iloc[some][["g", "rec_id", "w"]].copy()
        out["place"] = np.arange(len(taken) + 1, len(taken) + 1 + len(some), dtype=np.int32)
        return out

    first = lambda x, n: x.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o"))).where(F.col("rn") <= n)
    schema = "g string, rec_id long, w array<string>, place int"
    chosen, rest, seen = p.sparkSession.createDataFrame([], schema), p, pool
    while True:
        new = cut(first(rest, pool).select("g", "rec_id", "w", "rn").groupBy("g").cogroup(chosen.groupBy("g")).applyInPandas(take, schema))
        chosen = cut(chosen.unionByName(new))
        lists = chosen.groupBy("g").agg(F.count("*").alias("n"), F.collect_list("w").alias("ws"))  # at most `target` of a group
        short = lists.join(new.select("g").distinct(), "g", "left_semi").where(F.col("n") < target)
        if not short.join(sizes.where(F.col("rows") > seen), "g", "left_semi").head(1):
            break
        rest = p.join(short.select("g", "ws"), "g").where(~F.exists("ws", lambda t: text.overlap(F.col("w"), t) >= threshold)).join(chosen.select("g", "rec_id"), ["g", "rec_id"], "left_anti").drop("ws")
        seen += pool
    left = p.join(chosen.select("g", "rec_id"), ["g", "rec_id"], "left_anti").join(chosen.groupBy("g").agg(F.count("*").cast("int").alias("n")), "g").where(F.col("n") < target)
    fill = first(left, target).where(F.col("rn") + F.col("n") <= target).select("g", "rec_id", (F.col("n") + F.col("rn")).cast("int").alias("place"))
    return chosen.select("g", "rec_id", "place").unionByName(fill).withColumnRenamed("g", by)


def prefix_hits(docs: DataFrame, title: str, queries: list[str]) -> DataFrame:
    """(query, rec_id, hits): rows a title token of which starts with a query token longer than one character."""
    q = docs.sparkSession.createDataFrame([(x,) for x in queries], "query string")
    q = q.select("query", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > 1))).alias("p"))
    t = docs.select("rec_id", F.explode(F.array_distinct(F.split(F.lower(title), r"[^\p{L}\p{N}_]+"))).alias("t")).where("t != ''")
    return t.join(F.broadcast(q), F.expr("startswith(t, p)")).groupBy("query", "rec_id").agg(F.count_distinct("p").alias("hits"))  # the queries' tokens


def _p(spark, d):
    return table(spark, d, "papers")


def _q_fulltext(spark, d):
    """Papers with a document, filtered before the page is cut."""
    has = keyed(table(spark, d, "documents").select("canonical_id"), "canonical_id").where("canonical_id is not null").distinct()
    p = keyed(_p(spark, d).select("rec_id", "canonical_id", "citation_count"), "canonical_id")
    return p.join(has, "canonical_id", "left_semi").orderBy(F.desc_nulls_last("citation_count"), "rec_id").limit(100).select("rec_id", "citation_count")


def _q_candidates(spark, d):
    p = _p(spark, d).where(F.lower("source").contains("s2") & (F.coalesce("citation_count", F.lit(0)) >= 5))
    return p.orderBy(F.desc_nulls_last("citation_count"), F.desc_nulls_last("year"), "rec_id").limit(50).select("rec_id", "citation_count", "year")


def _q_years(spark, d):
    return _p(spark, d).where(F.col("year").between(2018, 2021)).select("rec_id", "year")


def _q_valid(spark, d):
    a = F.col("arxiv_id")
    return _p(spark, d).select("rec_id", F.coalesce(a.rlike(r"^(\d{4}\.\d{4,5}|[a-z\-]+/\d{7})$"), F.lit(False)).alias("valid"))


def _q_sanitised(spark, d):
    return sanitised(_p(spark, d).select("rec_id", "updated_at"))


def _q_lookup(spark, d):
    """Fetch log entries with the catalog's record under any of their keys, the latest record counting; the log's source goes first."""
    s = table(spark, d, "fetch_status")
    keys = s.select("arxiv_id", "source", F.explode(F.array(F.col("arxiv_id"), F.concat(F.lit("doi:"), "arxiv_id"))).alias("k"))
    p = _p(spark, d).select(F.explode(F.array_compact(F.array(F.col("arxiv_id"), F.concat(F.lit("doi:"), F.lower("doi"))))).alias("k"), "rec_id", "year", F.col("source").alias("_s"))
    last = p.groupBy("k").agg(F.max_by(F.struct("rec_id", "year", "_s"), "rec_id").alias("r"))
    j = keys.join(last, "k", "left").groupBy("arxiv_id", "source").agg(F.max("r").alias("r"))
    return j.select("arxiv_id", F.coalesce("source", "r._s").alias("source"), "r.rec_id", "r.year")


def _q_recent(spark, d):
    p = _p(spark, d).where("arxiv_id is not null").select("rec_id", "arxiv_id", "ingested_at")
    top = p.orderBy(F.desc("ingested_at"), F.desc("rec_id")).limit(50)
    return top.join(table(spark, d, "fetch_status").select("arxiv_id", "status", "n_refs"), "arxiv_id", "left").select("rec_id", "arxiv_id", "status", "n_refs")


def _q_intersection(spark, d):
    """Ranked and labelled papers in common, in rank order, by cleaned id."""
    r = _p(spark, d).where("citation_count > 0").select(arxiv_id(F.col("arxiv_id")).alias("id"), "citation_count").where("id is not null").groupBy("id").agg(F.max("citation_count").alias("c"))
    lab = table(spark, d, "fetch_status").where("n_refs >= 20").select(arxiv_id(F.col("arxiv_id")).alias("id"), "n_refs")
    return r.join(lab, "id").select("id", F.col("c").alias("citations"), "n_refs")


def _q_point(spark, d):
    """New counts for some papers, the others as they were."""
    old = catalog_nodes(_p(spark, d)).select("canonical_id", "citation_count")
    new = old.where(F.length("canonical_id") % 2 == 0).select("canonical_id", F.lit(5000).alias("citation_count"))
    return catalog.merged(old, new, "canonical_id", [], ["citation_count"])


def _q_union(spark, d):
    """Ids of all sources, each with the first source that has it."""
    parts = [("catalog", _p(spark, d).select("arxiv_id")), ("fetched", table(spark, d, "fetch_status").select("arxiv_id"))]
    every = None
    for i, (name, df) in enumerate(parts):
        df = df.where("arxiv_id is not null").select("arxiv_id", F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("s"))
        every = df if every is None else every.unionByName(df)
    return every.groupBy("arxiv_id").agg(F.min("s").alias("s")).select("arxiv_id", F.col("s.name").alias("source")).groupBy("source").agg(F.count("*").alias("ids"))


def _q_topics(spark, d):
    t = _p(spark, d).select("rec_id", F.trim("source").alias("topic")).where("topic != ''")
    return t.groupBy(F.lower("topic").alias("k")).agg(F.min_by("topic", "rec_id").alias("topic"), F.min("rec_id").alias("first")).select("topic", "first")


def _q_distinct_papers(spark, d):
    """Papers in the order in which their passages come."""
    f = retrieval._docs(spark, d).groupBy("section", "canonical_id").agg(F.min("doc_id").alias("at"))
    w = Window.partitionBy("section").orderBy("at")
    return f.withColumn("place", F.row_number().over(w)).where("place <= 20").select("section", "canonical_id", "place")


def _q_unvectored(spark, d):
    """Papers without a usable vector."""
    v = geometry.best_vectors(table(spark, d, "paper_vectors"))
    return catalog_nodes(_p(spark, d)).join(v.select(F.col("id").alias("canonical_id")), "canonical_id", "left_anti").select("canonical_id")


def _q_budget(spark, d):
    n = keyed(table(spark, d, "edges").select("cited_id"), "cited_id").where("cited_id is not null").groupBy("cited_id").agg(F.count("*").alias("unlocks"))
    return budgeted(n, [F.desc("unlocks"), F.col("cited_id")], 4.0, 2.5, 600.0, 250.0, 80)


def _q_topk(spark, d):
    e = table(spark, d, "embeddings")
    return nearest_rows(e, e.where("vec_id % 50 = 0"), 10).select("q", "vec_id", "rank", F.round("score", 4).alias("score"))


def _q_topk_label(spark, d):
    e = table(spark, d, "embeddings")
    return nearest_rows(e, e.where("vec_id % 50 = 0"), 5, "label").select("q", "vec_id", "rank")


def _q_mismatch(spark, d):
    """Queries whose best match has another label."""
    e = table(spark, d, "embeddings")
    top = nearest_rows(e, e.where("vec_id % 50 = 0"), 1)
    lab = e.select("vec_id", "label")
    return top.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q").where("label != ql").select("q", "vec_id", "label", "ql")


def _q_curated(spark, d):
    """Curated lists per source: by relevance to the topics, an arXiv id, momentum and overall impact, citations and length of the abstract."""
    score = impact.all_components(spark, d).select(F.col("cited_id").alias("canonical_id"), "momentum", "overall")
    p = keyed(_p(spark, d).select("rec_id", "canonical_id", "arxiv_id", "title", "abstract", "citation_count", "source"), "canonical_id")
    p = p.join(score, "canonical_id", "left").withColumn("src", F.coalesce(F.lower(F.trim("source")), F.lit("none")))
    p = p.withColumn("relevance", text.topic_relevance(F.col("title"), F.col("abstract")))
    order = [F.col("relevance"), F.col("arxiv_id").isNotNull().cast("int"), F.col("momentum"), F.col("overall"), F.col("citation_count"), F.length("abstract")]
    return curated(p, "src", order, F.col("relevance"))


def _q_best_dim(spark, d):
    m = geometry._q_dims(spark, d)
    return m.agg(F.min_by("dim", F.struct(-F.col("mrr"), F.col("dim"))).alias("dim"))


def _q_ids(spark, d):
    return table(spark, d, "fetch_status").select("arxiv_id").where("arxiv_id is not null and not startswith(arxiv_id, '#')").distinct().orderBy("arxiv_id")


def _q_purgeable(spark, d):
    """Fetched papers that are in the catalog and have a document."""
    s = keyed(table(spark, d, "fetch_status").where("status = 'ok'").select("arxiv_id", "canonical_id"), "canonical_id")
    docs = keyed(table(spark, d, "documents").select("canonical_id"), "canonical_id").where("canonical_id is not null")
    return s.join(docs, "canonical_id", "left_semi").join(_p(spark, d).where("arxiv_id is not null").select("arxiv_id"), "arxiv_id", "left_semi").select("arxiv_id")


def _q_overlap(spark, d):
    """References of each paper that its edges do not hold, and the other way round."""
    r = keyed(table(spark, d, "ref_edges").select("focal_id", "ref_id"), "focal_id", "ref_id").where("ref_id is not null").groupBy("focal_id").agg(F.collect_set("ref_id").alias("a"))
    e = keyed(table(spark, d, "edges").select("citer_id", "cited_id"), "citer_id", "cited_id").where("citer_id is not null and cited_id is not null").groupBy(F.col("citer_id").alias("focal_id")).agg(F.collect_set("cited_id").alias("b"))
    return r.join(e, "focal_id").select("focal_id", F.size(F.array_except("a", "b")).cast("long").alias("only_refs"), F.size(F.array_except("b", "a")).cast("long").alias("only_edges"), F.size(F.array_intersect("a", "b")).cast("long").alias("both"))


def _q_blend(spark, d):
    """References of two sources put together, missing columns null, each once."""
    r = table(spark, d, "ref_edges")
    a = r.where("source_api = 's2'").select("focal_id", "ref_id", "position")
    b = r.where("source_api = 'openalex'").select("focal_id", "ref_id")
    return a.unionByName(b, allowMissingColumns=True).where("trim(ref_id) != ''").groupBy("focal_id", "ref_id").agg(F.min("position").alias("position"))


def _q_from_text(spark, d):
    """arXiv ids named in free text: what a record says of itself in title, key and DOI."""
    t = F.concat_ws(" ", "title", "canonical_id", "doi")
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv: ?|10\.48550/arxiv\.)(\d{4}\.\d{4,5})"), 1)))
    return _p(spark, d).select("rec_id", F.array_join(ids, " ").alias("ids"))


def _q_json(spark, d):
    """JSON objects out of fenced or surrounded text."""
    e = table(spark, d, "events")
    t = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return e.select("event_id", F.get_json_object(F.regexp_extract(t, r"(?s)(\{.*\})", 1), "$.k").cast("long").alias("k"))


def _q_badges(spark, d):
    """Where a paper can be read, a label for it, and a title for those without one."""
    p = _p(spark, d)
    badge = F.when(F.col("arxiv_id").isNotNull(), "arXiv").when(F.col("doi").isNotNull(), "DOI").when(F.col("s2_id").isNotNull(), "S2").otherwise("none")
    first = F.substring(F.substring_index(F.coalesce("abstract", F.lit("")), ". ", 1), 1, 95)
    name = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(first)
    label = F.concat(F.when(F.length(name) > 80, F.concat(F.substring(name, 1, 80), F.lit("…"))).otherwise(name), F.lit(" ("), F.col("rec_id").cast("string"), F.lit(")"))
    return p.select("rec_id", badge.alias("badge"), label.alias("label"), F.regexp_extract(label, r"\((\d+)\)$", 1).cast("long").alias("id_back"))


def _q_dates(spark, d):
    p = _p(spark, d)
    iso = F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss")
    a, b = parsed_date(iso), parsed_date(F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), F.lit("-01-01")))
    return p.select("rec_id", scores.year_of(iso).cast("long").alias("y"), F.round(months_between(a, b), 6).alias("months"))


def _q_numbers(spark, d):
    p = _p(spark, d)
    return p.select("rec_id", F.round(scores.number(F.substring("doi", 4, 5), -1.0), 6).alias("n"), F.round(scores.ratio(F.col("year"), F.col("citation_count"), 0.0), 6).alias("r"))


def _q_prefix(spark, d):
    return prefix_hits(_p(spark, d), "title", ["novel cit", "weather", "x"])


def _q_context(spark, d):
    """What an answer to each paper's title could be made from."""
    f = retrieval._fused(spark, d).withColumn("section", F.coalesce("section", F.lit("")))
    base = f.select("canonical_id", "doc_id", F.col("canonical_id").alias("paper"), "section", "length", "dense", "bm25", "boost")
    return pipelines.answer_context(base, ["canonical_id"], "doc_id", "paper", 3000).select("canonical_id", "used", "coverage", F.array_join("refs", " ").alias("refs"))


def _q_covariates(spark, d):
    p = _p(spark, d).groupBy("canonical_id").agg(F.max("year").alias("year"), F.max(F.length("abstract")).alias("length")).where("canonical_id is not null")
    r = table(spark, d, "ref_edges").groupBy(F.col("focal_id").alias("canonical_id")).agg(F.count("*").alias("n"))
    return p.join(r, "canonical_id").select("canonical_id", "year", "length", "n", F.round(F.log1p(F.col("n").cast("double")), 6).alias("log_n"))


def _q_substring(spark, d):
    """Metrics with ids that match where one contains the other."""
    m = evaluation._retrieved(spark, d)
    top = F.slice("retrieved", 1, 6)
    near = lambda x: F.exists("expected", lambda e: F.contains(x, e) | F.contains(e, x))
    at = F.array_position(F.transform(top, near), True)
    return m.select("focal_id", F.exists("expected", lambda e: F.exists(top, lambda x: F.contains(x, e))).cast("int").alias("recall"), F.when(at > 0, F.round(1.0 / at, 6)).otherwise(0.0).alias("rr"))


def _q_evaluation_row(spark, d):
    lab = evaluation._labelled(spark, d)
    order = [F.desc("citation_count"), F.col("rec_id")]
    a = evaluation.spearman(lab, ["src"], "rel", "citation_count")
    b = evaluation.ndcg(lab, ["src"], "rel", order, 10).withColumnRenamed("ndcg", "ndcg10")
    c = evaluation.ndcg(lab, ["src"], "rel", order, 20).withColumnRenamed("ndcg", "ndcg20")
    return a.join(b, "src").join(c, "src")


def _q_modes(spark, d):
    """Papers per discovery mode with mean measures, over profiled papers."""
    p = geometry._q_profiles(spark, d).where("status = 'ok'")
    return p.groupBy("mode").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("m", "delta", "r2", "residual")))


def _q_size_sweep(spark, d):
    """Hit rate of the nearest same-label row as the index grows: subsets hold all queries' rows and hashed others, nested; one pass."""
    e = table(spark, d, "embeddings")
    shares = (8, 4, 2, 1)
    h = F.pmod(F.xxhash64("vec_id", F.lit(42)), F.lit(8))
    member = F.filter(F.array(*(F.when((h % s == 0) | (F.col("vec_id") % 50 == 0), F.lit(i)) for i, s in enumerate(shares))), lambda x: x.isNotNull())
    top = top_similar(e.withColumn("member", member), e.where("vec_id % 50 = 0"), 1, dims=(0,) * len(shares), member="member", least=0.0)
    lab = e.select("vec_id", "label")
    both = top.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q")
    one_in = F.element_at(F.array(*(F.lit(s) for s in shares)), F.col("variant") + 1)
    return both.groupBy(one_in.alias("one_in")).agg(F.round(F.avg((F.col("label") == F.col("ql")).cast("double")), 6).alias("hit"))


_R6 = evaluation._R
_SIMS = "s AS (SELECT q.vec_id AS q, q.label AS ql, e.vec_id, e.label, round(greatest(0, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])), 9) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)"
QUERIES = {
    "flt2_fulltext": _q_fulltext, "flt5_candidates": _q_candidates, "flt7_year_range": _q_years, "flt11_valid_ids": _q_valid, "flt14_sanitised": _q_sanitised,
    "jn3_jn4_lookup": _q_lookup, "jn8_recent": _q_recent, "jn10_intersection": _q_intersection, "ups5_point_update": _q_point, "ups7_grow_union": _q_union,
    "ded5_topics": _q_topics, "ded7_distinct_papers": _q_distinct_papers, "src22_unvectored": _q_unvectored, "win6_budget": _q_budget, "top3_vector_topk": _q_topk,
    "top4_filtered_topk": _q_topk_label, "win11_mismatches": _q_mismatch, "top8_curated": _q_curated, "top12_best_dim": _q_best_dim, "set4_sorted_ids": _q_ids,
    "set5_purgeable": _q_purgeable, "set6_overlap": _q_overlap, "set7_blend": _q_blend, "str5_ids_in_text": _q_from_text, "str10_json": _q_json, "str11_str12_badges": _q_badges,
    "dat1_dat2_dates": _q_dates, "mth1_mth2_numbers": _q_numbers, "txt1_jn2_prefix_hits": _q_prefix, "txt10_answer_context": _q_context, "nov11_covariates": _q_covariates,
    "evl2_substring_metrics": _q_substring, "evl6_evaluation_row": _q_evaluation_row, "agg11_agg12_modes": _q_modes, "evl17_win10_size_sweep": _q_size_sweep,
}
SQL = {
    "flt2_fulltext": f"SELECT rec_id, citation_count FROM papers WHERE {key_sql('canonical_id')} IN (SELECT {key_sql('canonical_id')} FROM documents) ORDER BY citation_count DESC NULLS LAST, rec_id LIMIT 100",
    "flt5_candidates": "SELECT rec_id, citation_count, year FROM papers WHERE contains(lower(source), 's2') AND coalesce(citation_count, 0) >= 5 ORDER BY citation_count DESC NULLS LAST, year DESC NULLS LAST, rec_id LIMIT 50",
    "flt7_year_range": "SELECT rec_id, year FROM papers WHERE year BETWEEN 2018 AND 2021",
    "flt11_valid_ids": r"SELECT rec_id, coalesce(regexp_full_match(arxiv_id, '\d{4}\.\d{4,5}|[a-z\-]+/\d{7}'), false) AS valid FROM papers",
    "flt14_sanitised": "SELECT rec_id, CASE WHEN isfinite(updated_at) THEN updated_at END AS updated_at FROM papers",
    "jn3_jn4_lookup": "WITH k AS (SELECT arxiv_id, source, unnest([arxiv_id, 'doi:' || arxiv_id]) AS k FROM fetch_status), p AS (SELECT unnest([arxiv_id, 'doi:' || lower(doi)]) AS k, rec_id, year, source AS s FROM papers), l AS (SELECT * FROM p WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY rec_id DESC) = 1), j AS (SELECT arxiv_id, source, s, rec_id, year, row_number() OVER (PARTITION BY arxiv_id, source ORDER BY rec_id DESC NULLS LAST) AS rn FROM k LEFT JOIN l USING (k)) SELECT arxiv_id, coalesce(source, s) AS source, rec_id, year FROM j WHERE rn = 1",
    "evl6_evaluation_row": f"WITH {evaluation._L}, {evaluation._RANKS}, o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY citation_count DESC, rec_id) AS r, row_number() OVER (PARTITION BY src ORDER BY rel DESC, citation_count DESC, rec_id) AS b FROM p), d AS (SELECT src, round(sum((pow(2, rel) - 1) / log2(r + 1)) FILTER (r <= 10) / sum((pow(2, rel) - 1) / log2(b + 1)) FILTER (b <= 10), 6) AS ndcg10, round(sum((pow(2, rel) - 1) / log2(r + 1)) FILTER (r <= 20) / sum((pow(2, rel) - 1) / log2(b + 1)) FILTER (b <= 20), 6) AS ndcg20 FROM o GROUP BY 1), h AS (SELECT src, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 6) END AS rho FROM k GROUP BY 1) SELECT src, n, rho, ndcg10, ndcg20 FROM h JOIN d USING (src)",
    "top12_best_dim": f"SELECT dim FROM ({geometry.SQL['evl16_dimension_sweep']}) ORDER BY mrr DESC, dim LIMIT 1",
    "jn8_recent": "SELECT p.rec_id, p.arxiv_id, status, n_refs FROM (SELECT * FROM papers WHERE arxiv_id IS NOT NULL ORDER BY ingested_at DESC, rec_id DESC LIMIT 50) p LEFT JOIN fetch_status s ON s.arxiv_id = p.arxiv_id",
    "jn10_intersection": "SELECT p.arxiv_id AS id, max(citation_count) AS citations, any_value(s.n_refs) AS n_refs FROM papers p JOIN fetch_status s ON s.arxiv_id = p.arxiv_id WHERE citation_count > 0 AND s.n_refs >= 20 GROUP BY 1",
    "ups5_point_update": f"SELECT k AS canonical_id, CASE WHEN length(k) % 2 = 0 THEN 5000 ELSE max(citation_count) END AS citation_count FROM (SELECT {key_sql('canonical_id')} AS k, citation_count FROM papers) WHERE k IS NOT NULL GROUP BY 1",
    "ups7_grow_union": "WITH a AS (SELECT DISTINCT arxiv_id FROM papers WHERE arxiv_id IS NOT NULL), b AS (SELECT DISTINCT arxiv_id FROM fetch_status WHERE arxiv_id IS NOT NULL AND arxiv_id NOT IN (SELECT arxiv_id FROM a)) SELECT * FROM (SELECT 'catalog' AS source, count(*) AS ids FROM a UNION ALL SELECT 'fetched', count(*) FROM b) WHERE ids > 0",
    "ded5_topics": "SELECT arg_min(topic, rec_id) AS topic, min(rec_id) AS first FROM (SELECT rec_id, trim(source) AS topic FROM papers) WHERE topic <> '' GROUP BY lower(topic)",
    "ded7_distinct_papers": f"WITH d AS (SELECT doc_id, section, {key_sql('canonical_id')} AS canonical_id FROM documents WHERE trim(text) <> ''), f AS (SELECT section, canonical_id, min(doc_id) AS t FROM d WHERE canonical_id IS NOT NULL GROUP BY 1, 2) SELECT section, canonical_id, row_number() OVER (PARTITION BY section ORDER BY t) AS place FROM f QUALIFY place <= 20",
    "src22_unvectored": f"WITH {geometry._VECS} SELECT DISTINCT {key_sql('canonical_id')} AS canonical_id FROM papers WHERE {key_sql('canonical_id')} IS NOT NULL AND {key_sql('canonical_id')} NOT IN (SELECT id FROM v)",
    "win6_budget": f"SELECT k AS cited_id, count(*) AS unlocks FROM (SELECT {key_sql('cited_id')} AS k FROM edges) WHERE k IS NOT NULL GROUP BY 1 ORDER BY unlocks DESC, k LIMIT 80",
    "top3_vector_topk": f"WITH {_SIMS} SELECT q, vec_id, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10",
    "top4_filtered_topk": f"WITH {_SIMS} SELECT q, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s WHERE label = ql) WHERE rank <= 5",
    "win11_mismatches": f"WITH {_SIMS} SELECT q, vec_id, label, ql FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank = 1 AND label <> ql",
    "set4_sorted_ids": "SELECT DISTINCT arxiv_id FROM fetch_status WHERE arxiv_id IS NOT NULL AND NOT starts_with(arxiv_id, '#') ORDER BY 1",
    "set5_purgeable": f"SELECT arxiv_id FROM fetch_status WHERE status = 'ok' AND {key_sql('canonical_id')} IN (SELECT {key_sql('canonical_id')} FROM documents) AND arxiv_id IN (SELECT arxiv_id FROM papers)",
    "set6_overlap": f"WITH r AS (SELECT f, list(DISTINCT k) AS a FROM (SELECT {key_sql('focal_id')} AS f, {key_sql('ref_id')} AS k FROM ref_edges) WHERE k IS NOT NULL GROUP BY 1), e AS (SELECT f, list(DISTINCT k) AS b FROM (SELECT {key_sql('citer_id')} AS f, {key_sql('cited_id')} AS k FROM edges) WHERE f IS NOT NULL AND k IS NOT NULL GROUP BY 1) SELECT f AS focal_id, len(a) - len(list_intersect(a, b)) AS only_refs, len(b) - len(list_intersect(a, b)) AS only_edges, len(list_intersect(a, b)) AS both FROM r JOIN e USING (f)",
    "set7_blend": "SELECT focal_id, ref_id, min(CASE WHEN source_api = 's2' THEN position END) AS position FROM ref_edges WHERE source_api IN ('s2', 'openalex') AND trim(ref_id) <> '' GROUP BY 1, 2",
    "str5_ids_in_text": r"SELECT rec_id, array_to_string(list_sort(list_distinct(regexp_extract_all(concat_ws(' ', title, canonical_id, doi), '(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv: ?|10\.48550/arxiv\.)(\d{4}\.\d{4,5})', 1))), ' ') AS ids FROM papers",
    "str10_json": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "dat1_dat2_dates": "SELECT rec_id, year(ingested_at AT TIME ZONE 'UTC')::BIGINT AS y, round(greatest(0.25, abs(epoch_us(date_trunc('second', ingested_at)) - epoch_us(make_timestamp(year, 1, 1, 0, 0, 0))) / 86400e6 / 30.44), 6) AS months FROM papers",
    "mth1_mth2_numbers": "SELECT rec_id, coalesce(TRY_CAST(nullif(trim(doi[4:8]), '') AS DOUBLE), -1) AS n, CASE WHEN coalesce(citation_count, 0) = 0 THEN 0 ELSE round(year / citation_count::DOUBLE, 6) END AS r FROM papers",
    "txt1_jn2_prefix_hits": r"WITH q AS (SELECT * FROM (VALUES ('novel cit', 'novel'), ('novel cit', 'cit'), ('weather', 'weather')) v(query, p)), t AS (SELECT rec_id, unnest(list_distinct(regexp_split_to_array(lower(title), '[^\p{L}\p{N}_]+'))) AS t FROM papers) SELECT query, rec_id, count(DISTINCT p) AS hits FROM t JOIN q ON starts_with(t, p) GROUP BY 1, 2",
    "nov11_covariates": "WITH p AS (SELECT canonical_id, max(year) AS year, max(length(abstract)) AS length FROM papers GROUP BY 1), r AS (SELECT focal_id, count(*) AS n FROM ref_edges GROUP BY 1) SELECT canonical_id, year, length, n, round(ln(1 + n), 6) AS log_n FROM p JOIN r ON focal_id = canonical_id",
    "evl2_substring_metrics": f"WITH {_R6}, z AS (SELECT focal_id, expected, retrieved[:6] AS t FROM m), w AS (SELECT focal_id, (len(list_filter(expected, lambda e: len(list_filter(t, lambda x: contains(x, e))) > 0)) > 0)::INT AS recall, list_position(list_transform(t, lambda x: len(list_filter(expected, lambda e: contains(x, e) OR contains(e, x))) > 0), true) AS pos FROM z) SELECT focal_id, recall, CASE WHEN coalesce(pos, 0) > 0 THEN round(1.0::DOUBLE / pos, 6) ELSE 0 END AS rr FROM w",
}
