"""Impact scores from yearly citation counts, enrichment merges and fuzzy title links."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import scores, text
from citeweave.functions.ids import doi_key
from citeweave.functions.skew import running
from citeweave.operators.components import connected_components
from citeweave.operators.graph import catalog_nodes, key_sql, keyed
from citeweave.session import cut, table


# Fixed values.
OVERALL = {"impact": 0.30, "momentum": 0.25, "influence": 0.20, "recency": 0.15, "breadth": 0.05, "accessibility": 0.05}


def yearly(edges: DataFrame) -> DataFrame:
    """(cited_id, total, first, counts): citations of each paper by year of fetch_date, as array<struct<year, n>>, and the earliest."""
    return yearly_of(keyed(edges.select("cited_id", "fetch_date"), "cited_id"))


def yearly_of(cites: DataFrame) -> DataFrame:
    """yearly for citations whose keys are spelled in one way already."""
    by = cites.where("cited_id is not null and fetch_date is not null").groupBy("cited_id", F.year("fetch_date").alias("year")).agg(F.count("*").alias("n"), F.min("fetch_date").alias("first"))
    return by.groupBy("cited_id").agg(F.sum("n").alias("total"), F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct("year", "n"))).alias("counts"))


def months_between(a: Column, b: Column) -> Column:
    """Days between over 30.44, at least a quarter."""
    return F.greatest(F.abs(F.unix_micros(b) - F.unix_micros(a)) / 86_400e6 / 30.44, F.lit(0.25))


def parsed_date(c: Column) -> Column:
    """A timestamp from ISO text, a date or a year; null where none fits."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.regexp_extract(c, r"^(\d{4})$", 1), F.lit("yyyy")))


def impact(df: DataFrame) -> DataFrame:
    """df with growth, acceleration, trajectory, the six component scores and their weighted sum, overall.

    df has total, counts (see yearly) and months, and fwci, percentile (of citations among its year, 0 to 1),
    influence_ratio, influential, countries, institutions and is_open, each of which may be null and then adds nothing.
    """
    n = F.size("counts")
    last, prev = F.element_at("counts", -1)["n"], F.when(n >= 2, F.try_element_at("counts", F.lit(-2))["n"])
    df = df.withColumns({"trajectory": scores.trajectory(F.col("counts"), F.col("total")), "velocity": F.round(F.col("total") / F.col("months"), 4)})
    df = df.withColumns({"growth": F.when(prev > 0, F.round(last / prev + 1e-9, 3)).when((prev == 0) & (last > 0), 99.0), "acceleration": F.when(prev.isNotNull(), last - prev)})
    cap = lambda c: F.least(c, F.lit(1.0))
    some = lambda c: F.coalesce(c, F.lit(0.0))
    up_to = lambda c, most: cap(F.col(c) / float(most))
    logs = lambda c, most: cap(F.log1p(F.col(c).cast("double")) / math.log1p(most))
    push = F.when(F.col("trajectory") == "exploding", 0.15).when(F.col("trajectory") == "growing", 0.08).otherwise(0.0)
    gained = some(up_to("velocity", 5) * 0.4) + some(up_to("growth", 3) * 0.35) + F.when(F.col("acceleration") > 0, up_to("acceleration", 30) * 0.25).otherwise(0.0)
    parts = {
        "impact": some(up_to("fwci", 5) * 0.45) + some(logs("total", 500) * 0.35) + some(F.col("percentile") * 0.20),
        "momentum": F.when(push > 0, cap(gained + push)).otherwise(gained),
        "influence": some(up_to("influence_ratio", 0.3) * 0.6) + some(logs("influential", 50) * 0.4),
        "recency": F.greatest(F.lit(0.0), 1.0 - F.col("months") * 30.44 / (5 * 365)),
        "breadth": some(up_to("countries", 4) * 0.5) + some(up_to("institutions", 5) * 0.5),
        "accessibility": F.coalesce(F.col("is_open"), F.lit(False)).cast("double"),
    }
    out = df.withColumns({k: F.round(cap(some(c)) + 1e-9, 4) for k, c in parts.items()})
    return out.withColumn("overall", F.round(sum((F.lit(w) * F.col(k) for k, w in OVERALL.items()), F.lit(1e-9)), 4))  # halves go up


def title_sets(papers: DataFrame) -> DataFrame:
    """(rec_id, words): the sorted set of words of each record's title; titles without words are left out."""
    return papers.select("rec_id", F.array_sort(text.plain_words(F.col("title"))).alias("words")).where("size(words) > 0")


def title_members(papers: DataFrame) -> DataFrame:
    """(rec_id, representative, n): each record with the smallest rec_id, and the number, of the records whose titles have the same words."""
    t = title_sets(papers)
    return t.join(t.groupBy("words").agg(F.min("rec_id").alias("representative"), F.count("*").alias("n")), "words").select("rec_id", "representative", "n")


def title_groups(papers: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(id, component) of each record whose title is linked to another record's, by the same words or by similar_titles; component is the smallest id of the group."""
    linked = connected_components(similar_titles(papers, threshold).select("a", "b")).withColumnRenamed("id", "representative")
    m = title_members(papers).join(linked, "representative", "left").where("n > 1 or component is not null")
    return m.select(F.col("rec_id").alias("id"), F.coalesce("component", "representative").alias("component"))


def similar_titles(papers: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(a, b, overlap): pairs of distinct titles whose word overlap over the larger set reaches the threshold.

    Titles are compared once per set of words. Each set emits its rarest words, enough that two sets above the
    threshold must share one (prefix filter), so no pair is lost and common words join nothing.
    """
    sets = title_sets(papers).groupBy("words").agg(F.min("rec_id").alias("id"))
    df = sets.select("id", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    ordered = sets.select("id", F.size("words").alias("n"), F.explode("words").alias("w")).join(df, "w").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    prefix = ordered.select("id", "n", F.explode(F.transform(F.slice("o", 1, keep), lambda x: x["w"])).alias("w"))
    a, b = prefix.alias("a"), prefix.alias("b")
    near = a.join(b, "w").where((F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    s = sets.select("id", "words")
    both = near.join(s.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(s.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
    return both.select("a", "b", text.overlap(F.col("wa"), F.col("wb")).alias("overlap")).where(F.col("overlap") >= threshold - 1e-9)


def _q_trajectories(spark, d):
    y = yearly(table(spark, d, "edges"))
    return y.select("cited_id", "total", scores.trajectory(F.col("counts"), F.col("total")).alias("trajectory"))


def all_components(spark, d: str) -> DataFrame:
    """All components from the graph and the catalog.

    fwci is citations over the mean of papers first cited in the same year, percentile the share of those with fewer;
    a citation is influential if its citer is cited at least three times; catalog sources and reference sources stand
    for countries and institutions; papers with an arXiv key are open.
    """
    e = table(spark, d, "edges")
    k = cut(keyed(e.select("citer_id", "cited_id", "fetch_date"), "citer_id", "cited_id").where("cited_id is not null"))
    df = cut(yearly_of(k).withColumns({"months": months_between(F.col("first"), F.lit("2026-07-01 00:00:00").cast("timestamp")), "cohort": F.year("first")}))
    counts = df.groupBy("cohort", "total").agg(F.count("*").alias("c"))
    below = running(counts, ["cohort"], [F.col("total")], F.col("c"), "below")
    size = df.groupBy("cohort").agg(F.count("*").alias("papers"), F.avg("total").alias("mean"))
    place = below.join(size, "cohort").select("cohort", "total", (F.col("below") / F.col("papers")).alias("percentile"), (F.col("total") / F.col("mean")).alias("fwci"))
    known = k.groupBy(F.col("cited_id").alias("citer_id")).agg(F.count("*").alias("n")).where("n >= 3").select("citer_id")
    infl = k.where("citer_id is not null").join(known, "citer_id").groupBy("cited_id").agg(F.count("*").alias("influential"))
    src = keyed(table(spark, d, "papers").select("canonical_id", F.lower(F.trim("source")).alias("s")), "canonical_id").groupBy(F.col("canonical_id").alias("cited_id")).agg(F.count_distinct("s").alias("countries"))
    api = keyed(table(spark, d, "ref_edges").select("ref_id", "source_api"), "ref_id").groupBy(F.col("ref_id").alias("cited_id")).agg(F.count_distinct("source_api").alias("institutions"))
    df = df.join(place, ["cohort", "total"]).join(infl, "cited_id", "left").join(src, "cited_id", "left").join(api, "cited_id", "left")
    df = df.withColumns({"influence_ratio": F.col("influential") / F.col("total"), "is_open": F.col("cited_id").startswith("arxiv:")})
    return impact(df).select("cited_id", "total", "trajectory", *OVERALL, "overall")


def _q_enriched(spark, d):
    """Catalog papers with what the graph and the fetch log know: the largest count, the status, the sources seen."""
    p, e, s = (table(spark, d, t) for t in ("papers", "edges", "fetch_status"))
    n = catalog_nodes(p)
    c = keyed(e.select("cited_id"), "cited_id").where("cited_id is not null").groupBy(F.col("cited_id").alias("canonical_id")).agg(F.count("*").alias("seen"))
    st = keyed(s.select("canonical_id", "status", "n_refs"), "canonical_id").where("canonical_id is not null").groupBy("canonical_id").agg(F.max("status").alias("status"), F.max("n_refs").alias("n_refs"))
    return n.join(c, "canonical_id", "left").join(st, "canonical_id", "left").select("canonical_id", F.greatest("citation_count", "seen").cast("long").alias("citations"), "status", "n_refs")


def _q_cascade(spark, d):
    """Scores attached to the fetch log by arXiv id, else canonical id: the first key that matches counts."""
    s, p = table(spark, d, "fetch_status"), table(spark, d, "papers")
    n = catalog_nodes(p)
    keys = keyed(s.select("arxiv_id", "canonical_id"), "canonical_id").select("arxiv_id", F.posexplode(F.array(F.concat(F.lit("arxiv:"), "arxiv_id"), F.col("canonical_id"))).alias("tier", "key")).where("key is not null")
    hit = keys.join(n.select(F.col("canonical_id").alias("key"), "citation_count", "year"), "key")
    return hit.groupBy("arxiv_id").agg(F.min_by(F.struct("citation_count", "year"), "tier").alias("m"), F.min("tier").cast("long").alias("tier")).select("arxiv_id", "m.citation_count", "m.year", "tier")


def _q_similar_titles(spark, d):
    return similar_titles(table(spark, d, "papers")).select("a", "b", F.round("overlap", 6).alias("overlap"))


def _q_title_groups(spark, d):
    """Groups of records whose titles are linked by equality or near equality."""
    return title_groups(table(spark, d, "papers"))


def _q_title_members(spark, d):
    return title_members(table(spark, d, "papers"))


def _q_local_enrichment(spark, d):
    """References with what the catalog can add: title and year by canonical id, else by the DOI of the key."""
    r = keyed(table(spark, d, "ref_edges").select("row_id", "ref_id"), "ref_id").where("ref_id is not null")
    p = table(spark, d, "papers")
    a = catalog_nodes(p).select(F.col("canonical_id").alias("ref_id"), F.col("title").alias("t1"), F.col("year").alias("y1"))
    b = p.select(F.concat(F.lit("doi:"), doi_key(F.col("doi"))).alias("ref_id"), "title", "year", "rec_id").where("ref_id is not null").groupBy("ref_id").agg(F.min_by("title", "rec_id").alias("t2"), F.max("year").alias("y2"))
    return r.join(a, "ref_id", "left").join(b, "ref_id", "left").select("row_id", F.coalesce("t1", "t2").alias("title"), F.coalesce("y1", "y2").alias("year"))


_Y = f"y AS (SELECT cited_id, sum(n)::BIGINT AS total, list(n ORDER BY yr) AS ns FROM (SELECT {key_sql('cited_id')} AS cited_id, year(fetch_date) AS yr, count(*) AS n FROM edges WHERE fetch_date IS NOT NULL GROUP BY 1, 2) WHERE cited_id IS NOT NULL GROUP BY 1), z AS (SELECT *, ns[-1] AS la, ns[-2] AS pr, coalesce(list_sum(ns[:-3]), 0) AS ol FROM y)"
_TRAJ = "CASE WHEN len(ns) < 2 THEN CASE WHEN total > 20 THEN 'growing' ELSE 'new_or_sparse' END WHEN pr = 0 AND la > 5 THEN 'exploding' WHEN pr > 0 AND la / pr::DOUBLE >= 2 AND la >= 5 THEN 'exploding' WHEN pr > 0 AND la / pr::DOUBLE >= 1.3 THEN 'growing' WHEN la >= pr * 0.85 AND la >= 3 THEN 'stable' WHEN la < pr * 0.5 AND ol > la THEN 'declining' WHEN total < 5 THEN 'dormant' ELSE 'stable' END"
_N = f"n AS (SELECT k AS canonical_id, max(year) AS year, max(citation_count) AS citation_count, arg_min(title, rec_id) FILTER (trim(title) <> '') AS title FROM (SELECT *, {key_sql('canonical_id')} AS k FROM papers) WHERE k IS NOT NULL GROUP BY 1)"
_DK = r"(CASE WHEN regexp_matches(regexp_replace(lower(trim(doi)), '^doi:\s*', ''), '^10\.[0-9]{4,9}/\S+$') THEN 'doi:' || regexp_replace(lower(trim(doi)), '^doi:\s*', '') END)"
_W = "list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '')))"
QUERIES = {
    "win7_trajectories": _q_trajectories,
    "sig9_impact": all_components,
    "jn6_enriched": _q_enriched,
    "jn7_key_cascade": _q_cascade,
    "jn16_similar_titles": _q_similar_titles,
    "jn16_title_members": _q_title_members,
    "ded3_title_groups": _q_title_groups,
    "jn5_local_enrichment": _q_local_enrichment,
}
SQL = {
    "win7_trajectories": f"WITH {_Y} SELECT cited_id, total, {_TRAJ} AS trajectory FROM z",
    "sig9_impact": f"""WITH {_Y}, k AS (SELECT {key_sql('citer_id')} AS citer, {key_sql('cited_id')} AS cited_id, fetch_date FROM edges), f AS (SELECT cited_id, min(fetch_date) AS first FROM k WHERE cited_id IS NOT NULL GROUP BY 1 HAVING first IS NOT NULL),
b AS (SELECT z.*, {_TRAJ} AS trajectory, year(first) AS cohort, greatest(abs(epoch_us(TIMESTAMP '2026-07-01') - epoch_us(first)) / 86400e6::DOUBLE / 30.44::DOUBLE, 0.25::DOUBLE) AS months FROM z JOIN f USING (cited_id)),
c AS (SELECT *, total / avg(total) OVER (PARTITION BY cohort) AS fwci, (rank() OVER (PARTITION BY cohort ORDER BY total) - 1) / (count(*) OVER (PARTITION BY cohort))::DOUBLE AS pct FROM b),
i AS (SELECT cited_id, count(*) AS infl FROM k WHERE cited_id IS NOT NULL AND citer IN (SELECT cited_id FROM k WHERE cited_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1), s AS (SELECT {key_sql('canonical_id')} AS cited_id, count(DISTINCT lower(trim(source))) AS co FROM papers GROUP BY 1), a AS (SELECT {key_sql('ref_id')} AS cited_id, count(DISTINCT source_api) AS ins FROM ref_edges GROUP BY 1),
g AS (SELECT *, round(total / months, 4) AS vel, CASE WHEN pr > 0 THEN round(la / pr::DOUBLE + 1e-9::DOUBLE, 3) WHEN pr = 0 AND la > 0 THEN 99 END AS gr, la - pr AS ac FROM c LEFT JOIN i USING (cited_id) LEFT JOIN s USING (cited_id) LEFT JOIN a USING (cited_id)),
m AS (SELECT *, coalesce(least(vel / 5, 1) * 0.4::DOUBLE, 0) + coalesce(least(gr / 3, 1) * 0.35::DOUBLE, 0) + CASE WHEN ac > 0 THEN least(ac / 30::DOUBLE, 1) * 0.25::DOUBLE ELSE 0 END AS mo FROM g),
p AS (SELECT cited_id, total, trajectory, round(least(1, least(fwci / 5, 1) * 0.45::DOUBLE + least(1, ln(1 + total::DOUBLE) / ln(501)) * 0.35::DOUBLE + pct * 0.2::DOUBLE) + 1e-9::DOUBLE, 4) AS impact, round(least(1, mo + CASE trajectory WHEN 'exploding' THEN 0.15::DOUBLE WHEN 'growing' THEN 0.08::DOUBLE ELSE 0 END) + 1e-9::DOUBLE, 4) AS momentum,
round(coalesce(least(1, infl / total::DOUBLE / 0.3::DOUBLE) * 0.6::DOUBLE, 0) + coalesce(least(1, ln(1 + infl::DOUBLE) / ln(51)) * 0.4::DOUBLE, 0) + 1e-9::DOUBLE, 4) AS influence, round(greatest(0, 1 - months * 30.44::DOUBLE / (5 * 365)) + 1e-9::DOUBLE, 4) AS recency,
round(coalesce(least(1, co / 4::DOUBLE) * 0.5::DOUBLE, 0) + coalesce(least(1, ins / 5::DOUBLE) * 0.5::DOUBLE, 0) + 1e-9::DOUBLE, 4) AS breadth, starts_with(cited_id, 'arxiv:')::INT::DOUBLE AS accessibility FROM m)
SELECT *, round(0.3::DOUBLE * impact + 0.25::DOUBLE * momentum + 0.2::DOUBLE * influence + 0.15::DOUBLE * recency + 0.05::DOUBLE * breadth + 0.05::DOUBLE * accessibility + 1e-9::DOUBLE, 4) AS overall FROM p""",
    "jn6_enriched": f"WITH {_N}, c AS (SELECT {key_sql('cited_id')} AS k, count(*) AS seen FROM edges GROUP BY 1), s AS (SELECT {key_sql('canonical_id')} AS k, max(status) AS status, max(n_refs) AS n_refs FROM fetch_status GROUP BY 1) SELECT canonical_id, greatest(citation_count, seen)::BIGINT AS citations, status, n_refs FROM n LEFT JOIN c ON c.k = canonical_id LEFT JOIN s ON s.k = canonical_id",
    "jn7_key_cascade": f"WITH {_N}, k AS (SELECT arxiv_id, 'arxiv:' || arxiv_id AS key, 0 AS tier FROM fetch_status UNION ALL SELECT arxiv_id, {key_sql('canonical_id')}, 1 FROM fetch_status) SELECT arxiv_id, citation_count, year, tier::BIGINT AS tier FROM k JOIN n ON n.canonical_id = k.key QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY tier) = 1",
    "jn16_similar_titles": f"WITH s AS (SELECT w, min(rec_id) AS id FROM (SELECT rec_id, {_W} AS w FROM papers) WHERE len(w) > 0 GROUP BY 1), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w))::DOUBLE AS o FROM s a JOIN s b ON a.id < b.id AND least(len(a.w), len(b.w)) >= 0.92 * greatest(len(a.w), len(b.w)) - 1e-9) SELECT a, b, round(o, 6) AS overlap FROM p WHERE o >= 0.92 - 1e-9",
    "jn16_title_members": f"SELECT rec_id, min(rec_id) OVER (PARTITION BY w) AS representative, count(*) OVER (PARTITION BY w) AS n FROM (SELECT rec_id, {_W} AS w FROM papers) WHERE len(w) > 0",
    "jn5_local_enrichment": f"WITH {_N}, b AS (SELECT {_DK} AS k, arg_min(title, rec_id) AS t2, max(year) AS y2 FROM papers GROUP BY 1), r AS (SELECT row_id, {key_sql('ref_id')} AS k FROM ref_edges) SELECT row_id, coalesce(n.title, t2) AS title, coalesce(n.year, y2) AS year FROM r LEFT JOIN n ON n.canonical_id = r.k LEFT JOIN b ON b.k = r.k WHERE r.k IS NOT NULL",
}
