"""The citation graph: counts, hubs, citers, fetch status, reference lists.

Edges are aggregated before they are joined, so joins move one row per paper rather than one per citation; counts of
distinct citers are partial before the shuffle, so the most cited paper is no hot task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.ids import key_text, split_key
from citeweave.session import table


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """df with each key column in its one spelling (see split_key); blank keys are null."""
    for c in columns:
        df = split_key(df, c, "_sc", "_id").withColumn(c, key_text(F.col("_sc"), F.col("_id"))).drop("_sc", "_id")
    return df


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct (citer_id, cited_id): spelled alike, without blanks and self-citations."""
    e = keyed(edges.select("citer_id", "cited_id"), "citer_id", "cited_id")
    return e.where("citer_id is not null and cited_id is not null and citer_id != cited_id").distinct()


def catalog_nodes(papers: DataFrame) -> DataFrame:
    """One row per canonical_id: the largest year and citation count and the first title by rec_id."""
    p = keyed(papers.select("canonical_id", "rec_id", "title", "year", "citation_count", "arxiv_id"), "canonical_id").where("canonical_id is not null")
    return p.groupBy("canonical_id").agg(F.max("year").alias("year"), F.max("citation_count").alias("citation_count"), F.min_by(F.when(F.trim("title") != "", F.col("title")), F.when(F.trim("title") != "", F.col("rec_id"))).alias("title"), F.max("arxiv_id").alias("arxiv_id"))


def citation_counts(edges: DataFrame) -> DataFrame:
    """(cited_id, citers): distinct citers of each cited paper."""
    return clean_edges(edges).groupBy("cited_id").agg(F.count("*").alias("citers"))


def ranked_citations(edges: DataFrame, papers: DataFrame, min_count: int = 2) -> DataFrame:
    """Cited papers with at least min_count citers, whether or not the catalog holds them."""
    c = citation_counts(edges).where(F.col("citers") >= min_count)
    return c.join(catalog_nodes(papers), c["cited_id"] == F.col("canonical_id"), "left").select("cited_id", "citers", "title", "year", "citation_count", F.col("canonical_id").isNotNull().alias("in_library"))


def example_citers(edges: DataFrame, n: int = 8) -> DataFrame:
    """(cited_id, citers, examples): the n smallest citers of each paper, `;`-joined.

    The smallest n of each salted part are taken first, so no task holds all citers of a paper.
    """
    e = clean_edges(edges)
    part = F.pmod(F.xxhash64("citer_id"), F.lit(16))
    a = e.withColumn("_p", part)
    a = a.withColumn("_rn", F.row_number().over(Window.partitionBy("cited_id", "_p").orderBy("citer_id"))).where(F.col("_rn") <= n)
    lists = a.groupBy("cited_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("citer_id")), 1, n), ";").alias("examples"))
    return e.groupBy("cited_id").agg(F.count("*").alias("citers")).join(lists, "cited_id")


def graph_stats(edges: DataFrame, papers: DataFrame, status: DataFrame) -> DataFrame:
    """One row of counts."""
    e = edges.agg(F.count("*").alias("edges"))
    p = papers.agg(F.count("*").alias("papers"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"))
    s = status.agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("ok", "empty", "error")), F.sum("n_refs").alias("refs"))
    return e.crossJoin(p).crossJoin(s)  # one row each


def _t(spark, d, *names):
    return (table(spark, d, n) for n in names)


def _q_counts(spark, d):
    return citation_counts(table(spark, d, "edges"))


def _q_ranked(spark, d):
    return ranked_citations(*_t(spark, d, "edges", "papers"), min_count=3)


def _q_hubs(spark, d):
    e, p = _t(spark, d, "edges", "papers")
    return ranked_citations(e, p, 1).orderBy(F.desc("citers"), F.desc_nulls_last("citation_count"), "cited_id").limit(25)


def _q_untitled(spark, d):
    """Hubs the catalog has no title for."""
    return ranked_citations(*_t(spark, d, "edges", "papers"), min_count=1).where("title is null").orderBy(F.desc("citers"), "cited_id").limit(200).select("cited_id", "citers")


def _q_no_global(spark, d):
    """Hubs without a global count, and the key to look it up by."""
    top = ranked_citations(*_t(spark, d, "edges", "papers"), min_count=1).orderBy(F.desc("citers"), "cited_id").limit(400)
    scheme, rest = F.substring_index("cited_id", ":", 1), F.col("cited_id").substr(F.instr("cited_id", ":") + 1, F.length("cited_id"))
    key = F.when(scheme == "arxiv", F.concat(F.lit("ARXIV:"), rest)).when(scheme == "doi", F.concat(F.lit("DOI:"), rest)).when(scheme == "s2", rest)
    return top.where("coalesce(citation_count, 0) = 0").select("cited_id", "citers", key.alias("lookup_key"))


def _q_examples(spark, d):
    return example_citers(table(spark, d, "edges"))


def _q_frequency(spark, d):
    """Share of scanned papers that cite each paper, at least 2."""
    r = keyed(table(spark, d, "ref_edges").select("focal_id", "ref_id"), "focal_id", "ref_id").where("focal_id is not null and ref_id is not null and focal_id != ref_id").distinct()
    n = r.agg(F.count_distinct("focal_id").alias("scanned"))
    c = r.groupBy("ref_id").agg(F.count("*").alias("n")).where("n >= 2")
    return c.crossJoin(n).select("ref_id", "n", F.round(F.col("n") / F.col("scanned"), 6).alias("share"))  # one row


def _q_stats(spark, d):
    return graph_stats(*_t(spark, d, "edges", "papers", "fetch_status"))


def _q_status(spark, d):
    s = table(spark, d, "fetch_status")
    return s.groupBy(F.coalesce("status", F.lit("none")).alias("status"), F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.sum("n_refs").alias("refs"))


def _q_pending(spark, d):
    """Catalog papers still to fetch: no ok status."""
    p, s = _t(spark, d, "papers", "fetch_status")
    ids = p.where("arxiv_id is not null").groupBy("arxiv_id").agg(F.max("citation_count").alias("citation_count"))
    return ids.join(s.where("status = 'ok'").select("arxiv_id"), "arxiv_id", "left_anti")


def _q_refs(spark, d):
    """Each paper's reference list in order, its own id and repeats left out, the first position counting."""
    r = keyed(table(spark, d, "ref_edges").select("row_id", "focal_id", "ref_id", "position"), "focal_id", "ref_id").where("ref_id is not null and ref_id != focal_id")
    first = r.groupBy("focal_id", "ref_id").agg(F.min(F.struct(F.coalesce("position", F.lit(2**31 - 1)).alias("p"), "row_id")).alias("at"))
    lists = first.groupBy("focal_id").agg(F.array_sort(F.collect_list(F.struct("at.p", "at.row_id", "ref_id"))).alias("l"))
    return lists.select("focal_id", F.size("l").cast("long").alias("n_refs"), F.array_join(F.transform("l", lambda x: x["ref_id"]), " ").alias("refs"))


def _q_replaced(spark, d):
    """The edge table after each focal's newest batch of references replaced its older ones."""
    r = keyed(table(spark, d, "ref_edges").select("focal_id", "ref_id", "fetch_date"), "focal_id", "ref_id").where("ref_id is not null and ref_id != focal_id")
    newest = r.groupBy("focal_id").agg(F.max("fetch_date").alias("newest"))
    keep = r.join(newest, "focal_id").where("newest is null or date_trunc('month', fetch_date) = date_trunc('month', newest)")
    return keep.select("focal_id", "ref_id").distinct()


def _q_cap(spark, d):
    """At most 6 references per paper, those with an abstract first, the rest in hashed order."""
    p, r = _t(spark, d, "papers", "ref_edges")
    has = keyed(p.select("canonical_id", "abstract"), "canonical_id").where("length(abstract) > 20").select(F.col("canonical_id").alias("ref_id")).distinct().withColumn("has", F.lit(1))
    e = keyed(r.select("focal_id", "ref_id"), "focal_id", "ref_id").where("ref_id is not null and ref_id != focal_id").distinct().join(has, "ref_id", "left")
    w = Window.partitionBy("focal_id").orderBy(F.desc_nulls_last("has"), F.xxhash64("ref_id", F.lit(17)), "ref_id")
    return e.withColumn("rn", F.row_number().over(w)).where("rn <= 6").groupBy("focal_id").agg(F.count("*").alias("kept"), F.count("has").alias("with_abstract"))


def _q_coverage(spark, d):
    """Share of each paper's references with an abstract, and whether it passes the gate for a profile."""
    p, r = _t(spark, d, "papers", "ref_edges")
    has = keyed(p.select("canonical_id", "abstract"), "canonical_id").where("length(abstract) > 20").select(F.col("canonical_id").alias("ref_id")).distinct().withColumn("has", F.lit(1))
    e = keyed(r.select("focal_id", "ref_id"), "focal_id", "ref_id").where("ref_id is not null and ref_id != focal_id").distinct().join(has, "ref_id", "left")
    c = e.groupBy("focal_id").agg(F.count("*").alias("n_refs"), F.count("has").alias("with_abstract"))
    share = F.col("with_abstract") / F.col("n_refs")
    return c.select("focal_id", "n_refs", "with_abstract", F.round(share, 6).alias("share"), ((F.col("with_abstract") >= 3) & (share >= 0.25)).alias("passes"))


def _q_sync(spark, d):
    """Catalog counts for graph nodes matched by canonical id or by arXiv id: two equi-joins instead of an OR."""
    p, s = _t(spark, d, "papers", "fetch_status")
    n = catalog_nodes(p)
    f = keyed(s.select("arxiv_id", "canonical_id"), "canonical_id")
    a = f.join(n.select("canonical_id", "citation_count"), "canonical_id").select(f["arxiv_id"], "citation_count")
    b = f.join(n.where("arxiv_id is not null").groupBy("arxiv_id").agg(F.max("citation_count").alias("citation_count")), "arxiv_id").select("arxiv_id", "citation_count")
    return a.unionByName(b).groupBy("arxiv_id").agg(F.max("citation_count").alias("citation_count"))


def _q_two_hops(spark, d):
    """Papers reached in exactly two citation steps from the ten largest hubs' references."""
    e = clean_edges(table(spark, d, "edges"))
    seeds = e.groupBy("citer_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "citer_id").limit(10).select(F.col("citer_id").alias("seed"))
    one = e.join(F.broadcast(seeds), e["citer_id"] == F.col("seed")).select("seed", F.col("cited_id").alias("mid"))  # ten rows
    two = one.join(e, one["mid"] == e["citer_id"]).select("seed", F.col("cited_id").alias("reached")).distinct()
    return two.groupBy("seed").agg(F.count("*").alias("reached"))


_S = r"regexp_replace({c}, '^[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+|[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+$', '', 'g')"
_K = r"""(CASE WHEN {s} = '' THEN NULL WHEN regexp_matches({s}, '^(arxiv:\s*)?\d{{4}}\.\d{{4,5}}(v\d+)?$', 'i') THEN 'arxiv:' || regexp_extract({s}, '\d{{4}}\.\d{{4,5}}')
 WHEN lower({s}[:4]) = 'doi:' OR lower({s}[:6]) = 'arxiv:' THEN lower({s}) WHEN instr({s}, ':') > 0 THEN lower({s}[:instr({s}, ':') - 1]) || {s}[instr({s}, ':'):] ELSE ':' || {s} END)"""


def key_sql(c: str) -> str:
    """DuckDB: the one spelling of the paper key in column c, null where blank."""
    return _K.format(s=_S.format(c=c))


_EDGES = f"e AS (SELECT DISTINCT a AS citer_id, b AS cited_id FROM (SELECT {key_sql('citer_id')} AS a, {key_sql('cited_id')} AS b FROM edges) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)"
_NODES = f"n AS (SELECT k AS canonical_id, max(year) AS year, max(citation_count) AS citation_count, arg_min(title, rec_id) FILTER (trim(title) <> '') AS title, max(arxiv_id) AS arxiv_id FROM (SELECT *, {key_sql('canonical_id')} AS k FROM papers) WHERE k IS NOT NULL GROUP BY 1)"
_C = "c AS (SELECT cited_id, count(*) AS citers FROM e GROUP BY 1)"
_RANKED = f"WITH {_EDGES}, {_NODES}, {_C}, r AS (SELECT cited_id, citers, title, year, citation_count, canonical_id IS NOT NULL AS in_library FROM c LEFT JOIN n ON cited_id = canonical_id) "
_REFS = f"f AS (SELECT row_id, position, fetch_date, {key_sql('focal_id')} AS focal_id, {key_sql('ref_id')} AS ref_id FROM ref_edges), g AS (SELECT * FROM f WHERE ref_id IS NOT NULL AND ref_id <> focal_id)"
_HAS = f"h AS (SELECT DISTINCT {key_sql('canonical_id')} AS ref_id, 1 AS has FROM papers WHERE length(abstract) > 20), u AS (SELECT DISTINCT g.focal_id, g.ref_id, has FROM g LEFT JOIN h ON g.ref_id = h.ref_id)"

QUERIES = {
    "jn1_citation_counts": _q_counts,
    "agg6_jn9_ranked": _q_ranked,
    "top5_top6_hubs": _q_hubs,
    "jn12_untitled_hubs": _q_untitled,
    "jn13_hubs_without_counts": _q_no_global,
    "jn14_example_citers": _q_examples,
    "agg5_reference_frequency": _q_frequency,
    "agg3_graph_stats": _q_stats,
    "ups8_fetch_status": _q_status,
    "flt13_pending": _q_pending,
    "win13_ded4_reference_lists": _q_refs,
    "ups4_replaced_edges": _q_replaced,
    "win8_capped_references": _q_cap,
    "nov6_coverage_gate": _q_coverage,
    "jn15_citation_sync": _q_sync,
    "graph_two_hops": _q_two_hops,
}
SQL = {
    "jn1_citation_counts": f"WITH {_EDGES} SELECT cited_id, count(*) AS citers FROM e GROUP BY 1",
    "agg6_jn9_ranked": _RANKED + "SELECT * FROM r WHERE citers >= 3",
    "top5_top6_hubs": _RANKED + "SELECT * FROM r ORDER BY citers DESC, citation_count DESC NULLS LAST, cited_id LIMIT 25",
    "jn12_untitled_hubs": _RANKED + "SELECT cited_id, citers FROM r WHERE title IS NULL ORDER BY citers DESC, cited_id LIMIT 200",
    "jn13_hubs_without_counts": _RANKED
    + "SELECT cited_id, citers, CASE WHEN starts_with(cited_id, 'arxiv:') THEN 'ARXIV:' || cited_id[7:] WHEN starts_with(cited_id, 'doi:') THEN 'DOI:' || cited_id[5:] WHEN starts_with(cited_id, 's2:') THEN cited_id[4:] END AS lookup_key FROM (SELECT * FROM r ORDER BY citers DESC, cited_id LIMIT 400) WHERE coalesce(citation_count, 0) = 0",
    "jn14_example_citers": f"WITH {_EDGES} SELECT cited_id, count(*) AS citers, array_to_string(list_sort(list(citer_id))[:8], ';') AS examples FROM e GROUP BY 1",
    "agg5_reference_frequency": f"WITH {_REFS}, d AS (SELECT DISTINCT focal_id, ref_id FROM g WHERE focal_id IS NOT NULL) SELECT ref_id, count(*) AS n, round(count(*) / (SELECT count(DISTINCT focal_id) FROM d)::DOUBLE, 6) AS share FROM d GROUP BY 1 HAVING count(*) >= 2",
    "agg3_graph_stats": "SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM papers WHERE deleted_at IS NOT NULL) AS deleted, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'error') AS error, sum(n_refs)::BIGINT AS refs FROM fetch_status",
    "ups8_fetch_status": "SELECT coalesce(status, 'none') AS status, coalesce(source, 'none') AS source, count(*) AS n, sum(n_refs)::BIGINT AS refs FROM fetch_status GROUP BY 1, 2",
    "flt13_pending": "SELECT arxiv_id, max(citation_count) AS citation_count FROM papers WHERE arxiv_id IS NOT NULL AND arxiv_id NOT IN (SELECT arxiv_id FROM fetch_status WHERE status = 'ok') GROUP BY 1",
    "win13_ded4_reference_lists": f"WITH {_REFS}, x AS (SELECT focal_id, ref_id, coalesce(position, 2147483647) AS p, row_id FROM g QUALIFY row_number() OVER (PARTITION BY focal_id, ref_id ORDER BY coalesce(position, 2147483647), row_id) = 1) SELECT focal_id, count(*) AS n_refs, string_agg(ref_id, ' ' ORDER BY p, row_id) AS refs FROM x GROUP BY 1",
    "ups4_replaced_edges": f"WITH {_REFS}, m AS (SELECT *, max(fetch_date) OVER (PARTITION BY focal_id) AS newest FROM g) SELECT DISTINCT focal_id, ref_id FROM m WHERE newest IS NULL OR date_trunc('month', fetch_date) = date_trunc('month', newest)",
    "win8_capped_references": f"WITH {_REFS}, {_HAS} SELECT focal_id, least(6, count(*)) AS kept, least(6, count(has)) AS with_abstract FROM u GROUP BY 1",
    "nov6_coverage_gate": f"WITH {_REFS}, {_HAS} SELECT focal_id, count(*) AS n_refs, count(has) AS with_abstract, round(count(has) / count(*)::DOUBLE, 6) AS share, count(has) >= 3 AND count(has) / count(*)::DOUBLE >= 0.25 AS passes FROM u GROUP BY 1",
    "jn15_citation_sync": f"WITH {_NODES}, f AS (SELECT arxiv_id, {key_sql('canonical_id')} AS k FROM fetch_status) SELECT arxiv_id, max(citation_count) AS citation_count FROM (SELECT f.arxiv_id, n.citation_count FROM f JOIN n ON f.k = n.canonical_id UNION ALL SELECT f.arxiv_id, n.citation_count FROM f JOIN n ON f.arxiv_id = n.arxiv_id) GROUP BY 1",
    "graph_two_hops": f"WITH {_EDGES}, s AS (SELECT citer_id AS seed FROM e GROUP BY 1 ORDER BY count(*) DESC, citer_id LIMIT 10) SELECT seed, count(DISTINCT b.cited_id) AS reached FROM s JOIN e a ON a.citer_id = seed JOIN e b ON b.citer_id = a.cited_id GROUP BY 1",
}
