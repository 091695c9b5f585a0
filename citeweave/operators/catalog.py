"""The paper catalog: scans, filters, paged browsing, merges and duplicates.

Every function takes and returns DataFrames and keeps them lazy. Where rows are cut or ranked the order is total
(the id is the last key), so results do not depend on the layout of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import scores, text
from citeweave.functions.ids import arxiv_id, doi_key
from citeweave.session import table

AS_OF = 2026
SORTS = {
    "citations_desc": ("citation_count", "year"),
    "year_desc": ("year", "citation_count"),
}


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; rows with equal keys in `order` come in any order, so give a total one."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def by_arxiv_id(papers: DataFrame, raw: str) -> DataFrame:
    """Rows whose arxiv_id is the one in `raw` after cleaning; none where raw holds no id."""
    return papers.where(F.col("arxiv_id") == arxiv_id(F.lit(raw)))


def browse(papers: DataFrame, category: str | None = None, min_year: int | None = None, min_citations: int | None = None, query: str | None = None, sort_by: str = "citations_desc", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the catalog. Filters are conjunctive; a min_year up to 1900 and min_citations up to 0 do not filter; nulls fail an active filter and sort last."""
    df = papers
    if category:
        df = df.where(F.lower("source").contains(category.lower()))
    if min_year and min_year > 1900:
        df = df.where(F.col("year") >= min_year)
    if min_citations and min_citations > 0:
        df = df.where(F.col("citation_count") >= min_citations)
    if query:
        df = df.where(F.lower("title").contains(query.lower()))
    order = [F.asc_nulls_last("title")] if sort_by == "title" else [F.desc_nulls_last(c) for c in SORTS[sort_by]]
    return df.orderBy(*order, "rec_id").offset(offset).limit(limit)


def post_filters(df: DataFrame, since: int | None = None, until: int | None = None, min_citations: int | None = None, arxiv_only: bool = False) -> DataFrame:
    """Filters on recommendations: a value that is missing or no number fails an active filter."""
    year, cites = scores.year_of(F.col("year")), scores.number(F.col("citation_count"))
    if since is not None:
        df = df.where(F.coalesce(year >= since, F.lit(False)))
    if until is not None:
        df = df.where(F.coalesce(year <= until, F.lit(False)))
    if min_citations is not None:
        df = df.where(F.coalesce(cites >= min_citations, F.lit(False)))
    return df.where(F.col("arxiv_id").isNotNull()) if arxiv_only else df


def overfetch(k: int, filters_active: bool) -> int:
    """How many rows to rank so that k are left after filtering."""
    return min(max(6 * k, 40), 300) if filters_active else k


def cleaned(papers: DataFrame, min_abstract: int = 80) -> DataFrame:
    """Rows with a title and a long enough abstract (a short one does with an id and citations) that are not noisy (or relevant)."""
    long = F.length(F.coalesce("abstract", F.lit(""))) >= min_abstract
    kept = long | (F.col("arxiv_id").isNotNull() & (F.coalesce("citation_count", F.lit(0)) > 0))
    fine = ~text.noisy(F.col("title"), F.col("abstract")) | (text.topic_relevance(F.col("title"), F.col("abstract")) >= 0.5)
    return papers.where((F.trim(F.coalesce("title", F.lit(""))) != "") & kept & fine)


def merged(old: DataFrame, new: DataFrame, key: str, overwrite: list[str], keep: list[str], blank_is_null: bool = False) -> DataFrame:
    """old with new merged in by key: `overwrite` columns take the new value where the key is new or known there, `keep` columns only where it is not null.

    A key must be unique in each input. blank_is_null lets a blank text not replace a value.
    """
    cols = [*overwrite, *keep]
    n = new.select(F.col(key), F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in cols))
    both = old.select(key, *cols).join(n, key, "full")

    def value(c: str) -> Column:
        v = F.col(f"_{c}")
        if blank_is_null and dict(new.dtypes)[c] == "string":
            v = F.when(F.trim(v) != "", v)
        return (F.when(F.col("_new"), v).otherwise(F.col(c)) if c in overwrite else F.coalesce(v, F.col(c))).alias(c)

    return both.select(key, *(value(c) for c in cols))


def filled(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Old fields that are null, blank or 0 are filled from new; keys only in new are added."""
    n = new.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in cols))
    kinds = dict(old.dtypes)
    falsy = lambda c: F.col(c).isNull() | (F.col(c) == ("" if kinds[c] == "string" else 0))
    return old.select(key, *cols).join(n, key, "full").select(key, *(F.when(falsy(c), F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) for c in cols))


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key by `at` (null is oldest), ties to the largest `tie`; aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull(), at, tie)).alias("_r"))
    return best.select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def surrogate_key(arxiv: Column, doi: Column, title: Column) -> Column:
    """arXiv id, else doi:<sanitised, 80 characters>, else noarxiv:<12 hex digits of the title's sha1>."""
    d = F.substring(F.regexp_replace(doi, r"[^A-Za-z0-9._/-]", "_"), 1, 80)
    return F.coalesce(arxiv, F.concat(F.lit("doi:"), F.when(d != "", d)), F.concat(F.lit("noarxiv:"), F.substring(F.sha1(F.coalesce(title, F.lit(""))), 1, 12)))


def without_duplicates(papers: DataFrame) -> DataFrame:
    """One record per arXiv id, then per DOI: the richest (most fields, longest abstract, most citations, smallest rec_id).

    Records without the tier's key pass it unchanged. The kept record takes the group's largest citation count.
    """
    fields = sum((F.col(c).isNotNull().cast("int") for c in ("arxiv_id", "doi", "abstract", "year", "citation_count")), F.lit(0))
    df = papers.withColumns({"_rich": F.struct(fields, F.length(F.coalesce("abstract", F.lit(""))), F.coalesce("citation_count", F.lit(-1)), -F.col("rec_id")), "_doi": doi_key(F.col("doi"))})
    cols = df.columns
    for key in ("arxiv_id", "_doi"):
        k = F.coalesce(F.col(key), F.concat(F.lit("\0"), F.col("rec_id").cast("string")))
        best = df.groupBy(k.alias("_k")).agg(F.max_by(F.struct(*cols), "_rich").alias("_r"), F.max("citation_count").alias("_cites"))
        df = best.select(*(F.col("_cites").alias(c) if c == "citation_count" else F.col("_r")[c].alias(c) for c in cols))
    return df.drop("_rich", "_doi")


def year_band(year: Column) -> Column:
    return F.when(year.isNull(), "unknown").when(year >= 2024, "2024+").when(year >= 2021, "2021-2023").when(year >= 2018, "2018-2020").otherwise("pre-2018")


def stratified(papers: DataFrame, n: int, strata: list[str], id_: str, seed: int = 42) -> DataFrame:
    """A sample of about n rows: each stratum gets max(1, round(n x share)) rows in hashed order, the same on each run."""
    total = papers.agg(F.count("*").alias("_all"))
    size = papers.groupBy(*strata).agg(F.count("*").alias("_n"))
    alloc = size.crossJoin(F.broadcast(total)).withColumn("_take", F.greatest(F.lit(1), F.round(F.lit(n) * F.col("_n") / F.col("_all"))).cast("int"))  # one row
    ranked = papers.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy(F.xxhash64(id_, F.lit(seed)), id_))).where(F.col("_rn") <= max(1, n))  # no stratum takes more; that many rows of each task
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"a.{c}")) for c in strata]
    return ranked.alias("p").join(alloc.alias("a"), same).where("p._rn <= a._take").select("p.*").drop("_rn")


def _papers(spark, d: str) -> DataFrame:
    return table(spark, d, "papers")


def _q_lookup(spark, d):
    p = _papers(spark, d)
    return p.where(F.col("arxiv_id").isNotNull()).select("rec_id", arxiv_id(F.concat(F.lit("https://arxiv.org/abs/"), F.col("arxiv_id"), F.lit("v3"))).alias("id"))


def _q_browse(**kw):
    return lambda spark, d: browse(_papers(spark, d), **kw).select("rec_id", "title", "year", "citation_count")


def _q_post(spark, d):
    return post_filters(_papers(spark, d), since=2019, until=2024, min_citations=5, arxiv_only=True).select("rec_id", "year", "citation_count")


def _q_cleaned(spark, d):
    return cleaned(_papers(spark, d)).select("rec_id", "title")


def _q_titles(spark, d):
    t = F.col("title")
    return _papers(spark, d).select("rec_id", text.bad_title(t).alias("bad"), text.plain_title(t).alias("plain"), text.clean_text(F.col("abstract")).alias("clean"), text.noisy(t, F.col("abstract")).alias("noisy"), F.round(text.topic_relevance(t, F.col("abstract")), 6).alias("relevance"))


def _q_keys(spark, d):
    cid = F.coalesce(F.concat(F.lit("arxiv:"), F.col("arxiv_id")), F.concat(F.lit("s2:"), F.col("s2_id")), F.concat(F.lit("doi:"), F.lower("doi")))
    return _papers(spark, d).select("rec_id", cid.alias("canonical"), surrogate_key(F.col("arxiv_id"), F.col("doi"), F.col("title")).alias("surrogate"), text.clean_doi(F.col("doi")).alias("doi_clean"), doi_key(F.col("doi")).alias("doi_key"), F.coalesce("arxiv_id", F.concat(F.lit("doi:"), F.col("doi")), F.concat(F.lit("title:"), F.substring("title", 1, 60))).alias("paper_key"))


def _q_embedding_text(spark, d):
    t, a = F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))
    return _papers(spark, d).select("rec_id", F.when(a != "", F.concat_ws("\n", t, t, a)).when(t != "", t).alias("embed_text"))


def _q_stats(spark, d):
    p = _papers(spark, d)
    return p.agg(F.count("*").alias("n"), F.count_if(F.col("citation_count") > 0).alias("cited"), F.coalesce(F.min("year"), F.lit(2017)).alias("min_year"), F.coalesce(F.max("year"), F.lit(2026)).alias("max_year"), F.round(F.avg(F.when(F.col("citation_count") > 0, F.col("citation_count"))), 6).alias("avg_cites"), F.count("doi").alias("with_doi"), F.max("citation_count").alias("max_cites"))


def _q_sources(spark, d):
    s = F.lower(F.trim("source"))
    return _papers(spark, d).where(s != "").groupBy(s.alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)


def _q_categories(spark, d):
    p = table(spark, d, "part").select(F.explode(F.array_distinct(F.filter(F.transform(F.split("p_type", " "), F.trim), lambda x: x != ""))).alias("category"))
    return p.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(15)


def _q_category_any(spark, d):
    return table(spark, d, "part").where(F.exists(F.split("p_type", " "), lambda c: F.lower(c).contains("promo"))).select("p_partkey", "p_type")


def _q_upsert(spark, d):
    """(old, new): the first delivered record of each arXiv id, and the last one of those delivered again beside the fetch log's ids."""
    p = _papers(spark, d).where("arxiv_id is not null").select("arxiv_id", "rec_id", "title", "doi", "year", "citation_count", "ingested_at")
    cols = ["title", "doi", "year", "citation_count"]
    pick = F.struct("ingested_at", "rec_id", *cols)
    both = p.groupBy("arxiv_id").agg(F.min(pick).alias("o"), F.max(pick).alias("n"), F.count("*").alias("times"))
    old = both.select("arxiv_id", *(F.col("o")[c].alias(c) for c in cols))
    again = both.where("times > 1").select("arxiv_id", F.upper(F.col("n")["title"]).alias("title"), F.lit("").alias("doi"), F.col("n")["year"].alias("year"), F.when(F.col("n")["rec_id"] % 2 == 1, F.col("n")["citation_count"] + 1).alias("citation_count"))
    fetched = table(spark, d, "fetch_status").where("arxiv_id is not null").groupBy("arxiv_id").agg(F.max("n_refs").alias("citation_count")).join(both.select("arxiv_id"), "arxiv_id", "left_anti")
    return old, again.unionByName(fetched.select("arxiv_id", F.lit("fetched").alias("title"), F.lit("").alias("doi"), F.lit(None).cast("int").alias("year"), "citation_count"))


def _q_merge(spark, d):
    old, new = _q_upsert(spark, d)
    return merged(old, new, "arxiv_id", ["title", "doi"], ["year", "citation_count"])


def _q_merge_coalesce(spark, d):
    old, new = _q_upsert(spark, d)
    return merged(old, new, "arxiv_id", [], ["title", "doi", "year", "citation_count"], blank_is_null=True)


def _q_fill(spark, d):
    old, new = _q_upsert(spark, d)
    return filled(old.withColumn("doi", F.coalesce("doi", F.lit(""))), new.withColumn("doi", F.lit("10.1/x")), "arxiv_id", ["title", "doi", "year", "citation_count"])


def _q_latest(spark, d):
    return latest(_papers(spark, d).where("arxiv_id is not null").select("arxiv_id", "rec_id", "ingested_at", "citation_count"), ["arxiv_id"], "ingested_at", "rec_id").select("arxiv_id", "rec_id", "citation_count")


def _q_dedupe(spark, d):
    return without_duplicates(_papers(spark, d)).select("rec_id", "arxiv_id", "citation_count")


def _q_first_source(spark, d):
    p = _papers(spark, d).withColumn("key", F.coalesce("arxiv_id", doi_key(F.col("doi")), text.plain_title(F.col("title"))))
    return first_per_key(p.where("key != ''"), ["key"], [F.col("ingested_at"), F.col("rec_id")]).select("key", "rec_id")


def _q_topics(spark, d):
    p = _papers(spark, d).where("arxiv_id is not null").groupBy("arxiv_id").agg(F.min("rec_id").alias("rec_id"), F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("source")))), ";").alias("sources"))
    return p


def _q_bands(spark, d):
    return _papers(spark, d).groupBy(year_band(F.col("year")).alias("band")).agg(F.count("*").alias("n"))


def _q_allocation(spark, d):
    p = _papers(spark, d).select("rec_id", year_band(F.col("year")).alias("band"), F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("src"))
    return stratified(p, 200, ["band", "src"], "rec_id").groupBy("band", "src").agg(F.count("*").alias("taken"))


def _q_signals(spark, d):
    c, y = F.col("citation_count"), F.col("year")
    return _papers(spark, d).select("rec_id", *(F.round(x, 6).alias(n) for n, x in {"recency": scores.recency(y, AS_OF), "citation": scores.citation(c), "velocity": scores.velocity(c, y, AS_OF)}.items()))


def _q_export(spark, d):
    p = _papers(spark, d).where("arxiv_id is not null")
    return p.select("arxiv_id", "rec_id", F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), F.lit("-01-01")).alias("published_date"), F.coalesce("citation_count", F.lit(0)).alias("citations"))


def _q_ids(spark, d):
    """Existing ids: of the catalog and of the fetch log."""
    a = _papers(spark, d).select(arxiv_id(F.col("arxiv_id")).alias("id"))
    return a.unionByName(table(spark, d, "fetch_status").select(arxiv_id(F.col("arxiv_id")).alias("id"))).where("id is not null").distinct()


def _q_new_ids(spark, d):
    """Ids of the fetch log that the catalog lacks, and the other way round."""
    a = _papers(spark, d).select("arxiv_id").where("arxiv_id is not null").distinct()
    b = table(spark, d, "fetch_status").select("arxiv_id").distinct()
    return b.join(a, "arxiv_id", "left_anti").withColumn("only_in", F.lit("fetched")).unionByName(a.join(b, "arxiv_id", "left_anti").withColumn("only_in", F.lit("catalog")))


_OLDNEW = """WITH q AS (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY ingested_at, rec_id) AS first, row_number() OVER (PARTITION BY arxiv_id ORDER BY ingested_at DESC, rec_id DESC) AS last FROM papers WHERE arxiv_id IS NOT NULL),
o AS (SELECT arxiv_id, title, doi, year, citation_count FROM q WHERE first = 1), n AS (SELECT arxiv_id, upper(title) AS title, '' AS doi, year, CASE WHEN rec_id % 2 = 1 THEN citation_count + 1 END AS citation_count FROM q WHERE last = 1 AND first > 1
  UNION ALL SELECT arxiv_id, 'fetched', '', NULL, max(n_refs) FROM fetch_status WHERE arxiv_id IS NOT NULL AND arxiv_id NOT IN (SELECT arxiv_id FROM q) GROUP BY 1)
"""
_DOI = r"(CASE WHEN regexp_matches(regexp_replace(lower(trim(doi)), '^doi:\s*', ''), '^10\.[0-9]{4,9}/\S+$') THEN regexp_replace(lower(trim(doi)), '^doi:\s*', '') END)"
_PLAIN = "trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g'))"
_BAND = "CASE WHEN year IS NULL THEN 'unknown' WHEN year >= 2024 THEN '2024+' WHEN year >= 2021 THEN '2021-2023' WHEN year >= 2018 THEN '2018-2020' ELSE 'pre-2018' END"
_RICH = "(arxiv_id IS NOT NULL)::INT + (doi IS NOT NULL)::INT + (abstract IS NOT NULL)::INT + (year IS NOT NULL)::INT + (citation_count IS NOT NULL)::INT"
_RECENCY = "CASE WHEN yy IS NULL THEN 0.3 ELSE pow(0.5::DOUBLE, greatest(0, 2026 - yy) / 4.0::DOUBLE) END"
_CITATION = "CASE WHEN citation_count IS NULL OR citation_count < 0 THEN 0.3 ELSE least(1, ln(1 + citation_count::DOUBLE) / ln(501)) END"
_VELOCITY = "CASE WHEN yy IS NULL THEN 0.3 ELSE least(1, ln(1 + greatest(0, coalesce(citation_count, 0)) / greatest(1, 2026 - yy)::DOUBLE) / ln(51)) END"
_YY = "TRY_CAST(nullif(regexp_extract(year::VARCHAR, '((19|20)[0-9]{2})', 1), '') AS INT)"

QUERIES = {
    "src2_id_lookup": _q_lookup,
    "flt1_browse_citations": _q_browse(category="arxiv", min_year=2018, min_citations=10, limit=60, offset=20),
    "top2_browse_year": _q_browse(sort_by="year_desc", limit=100, offset=50),
    "top2_browse_title": _q_browse(query="novelty", sort_by="title", limit=100),
    "flt3_post_filters": _q_post,
    "flt10_cleaned": _q_cleaned,
    "flt8_flt9_str4_sig10_title_rules": _q_titles,
    "str2_str3_ups3_keys": _q_keys,
    "str9_embedding_text": _q_embedding_text,
    "agg1_agg10_catalog_stats": _q_stats,
    "agg2_top_sources": _q_sources,
    "agg9_top_categories": _q_categories,
    "flt6_category_any": _q_category_any,
    "ups1_merge": _q_merge,
    "ups2_coalesce_merge": _q_merge_coalesce,
    "ups6_fill_missing": _q_fill,
    "ups9_latest": _q_latest,
    "ded3_tiers": _q_dedupe,
    "ded2_first_source": _q_first_source,
    "ded1_topics_union": _q_topics,
    "dat3_year_bands": _q_bands,
    "win9_allocation": _q_allocation,
    "sig1_sig2_sig3_signals": _q_signals,
    "src5_export": _q_export,
    "set2_existing_ids": _q_ids,
    "set1_set3_reconcile": _q_new_ids,
}
SQL = {
    "src2_id_lookup": r"SELECT rec_id, CASE WHEN regexp_full_match(arxiv_id, '\d{4}\.\d{4,5}') THEN arxiv_id END AS id FROM papers WHERE arxiv_id IS NOT NULL",
    "flt1_browse_citations": "SELECT rec_id, title, year, citation_count FROM papers WHERE contains(lower(source), 'arxiv') AND year >= 2018 AND citation_count >= 10 ORDER BY citation_count DESC NULLS LAST, year DESC NULLS LAST, rec_id LIMIT 60 OFFSET 20",
    "top2_browse_year": "SELECT rec_id, title, year, citation_count FROM papers ORDER BY year DESC NULLS LAST, citation_count DESC NULLS LAST, rec_id LIMIT 100 OFFSET 50",
    "top2_browse_title": "SELECT rec_id, title, year, citation_count FROM papers WHERE contains(lower(title), 'novelty') ORDER BY title ASC NULLS LAST, rec_id LIMIT 100",
    "flt3_post_filters": f"SELECT rec_id, year, citation_count FROM papers WHERE {_YY} BETWEEN 2019 AND 2024 AND citation_count >= 5 AND arxiv_id IS NOT NULL",
    "flt10_cleaned": "SELECT rec_id, title FROM papers WHERE trim(coalesce(title, '')) <> '' AND (length(coalesce(abstract, '')) >= 80 OR (arxiv_id IS NOT NULL AND coalesce(citation_count, 0) > 0)) AND NOT regexp_matches(coalesce(title, '') || ' ' || coalesce(abstract, ''), '" + "|".join(text.NOISE) + "', 'i')",
    "flt8_flt9_str4_sig10_title_rules": "SELECT rec_id, length(trim(coalesce(title, ''))) < 8 OR regexp_matches(trim(coalesce(title, '')), '^(" + "|".join(text.BAD_TITLES) + r")', 'i') AS bad, " + _PLAIN + r" AS plain, trim(regexp_replace(abstract, '\s+', ' ', 'g')) AS clean, regexp_matches(coalesce(title, '') || ' ' || coalesce(abstract, ''), '" + "|".join(text.NOISE) + "', 'i') AS noisy, round(least(1, (" + " + ".join([f"regexp_matches(b, '{p}')::INT" for p in text.TOPIC_KEYWORDS] + [f"2 * contains(b, '{s}')::INT" for s in text.SEED_TOPICS]) + ") / 4.0::DOUBLE), 6) AS relevance FROM (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS b FROM papers)",
    "str2_str3_ups3_keys": "SELECT rec_id, coalesce('arxiv:' || arxiv_id, 's2:' || s2_id, 'doi:' || lower(doi)) AS canonical, coalesce(arxiv_id, 'doi:' || nullif(regexp_replace(doi, '[^A-Za-z0-9._/-]', '_', 'g')[:80], ''), 'noarxiv:' || sha1(coalesce(title, ''))[:12]) AS surrogate, nullif(trim(replace(doi, 'https://doi.org/', '')), '') AS doi_clean, " + _DOI + " AS doi_key, coalesce(arxiv_id, 'doi:' || doi, 'title:' || title[:60]) AS paper_key FROM papers",
    "str9_embedding_text": "SELECT rec_id, CASE WHEN coalesce(abstract, '') <> '' THEN coalesce(title, '') || chr(10) || coalesce(title, '') || chr(10) || abstract WHEN coalesce(title, '') <> '' THEN title END AS embed_text FROM papers",
    "agg1_agg10_catalog_stats": "SELECT count(*) AS n, count(*) FILTER (citation_count > 0) AS cited, coalesce(min(year), 2017) AS min_year, coalesce(max(year), 2026) AS max_year, round(avg(citation_count) FILTER (citation_count > 0), 6) AS avg_cites, count(doi) AS with_doi, max(citation_count) AS max_cites FROM papers",
    "agg2_top_sources": "SELECT lower(trim(source)) AS source, count(*) AS n FROM papers WHERE trim(source) <> '' GROUP BY 1 ORDER BY n DESC, source LIMIT 12",
    "agg9_top_categories": "SELECT category, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split(p_type, ' '), lambda x: x <> ''))) AS category FROM part) GROUP BY 1 ORDER BY n DESC, category LIMIT 15",
    "flt6_category_any": "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'promo')",
    "ups1_merge": _OLDNEW + "SELECT coalesce(o.arxiv_id, n.arxiv_id) AS arxiv_id, CASE WHEN n.arxiv_id IS NOT NULL THEN n.title ELSE o.title END AS title, CASE WHEN n.arxiv_id IS NOT NULL THEN n.doi ELSE o.doi END AS doi, coalesce(n.year, o.year) AS year, coalesce(n.citation_count, o.citation_count) AS citation_count FROM o FULL JOIN n ON o.arxiv_id = n.arxiv_id",
    "ups2_coalesce_merge": _OLDNEW + "SELECT coalesce(o.arxiv_id, n.arxiv_id) AS arxiv_id, coalesce(nullif(trim(n.title), ''), o.title) AS title, coalesce(nullif(trim(n.doi), ''), o.doi) AS doi, coalesce(n.year, o.year) AS year, coalesce(n.citation_count, o.citation_count) AS citation_count FROM o FULL JOIN n ON o.arxiv_id = n.arxiv_id",
    "ups6_fill_missing": _OLDNEW + "SELECT coalesce(o.arxiv_id, n.arxiv_id) AS arxiv_id, coalesce(nullif(o.title, ''), n.title, o.title) AS title, CASE WHEN coalesce(o.doi, '') <> '' THEN o.doi WHEN n.arxiv_id IS NOT NULL THEN '10.1/x' ELSE coalesce(o.doi, '') END AS doi, coalesce(nullif(o.year, 0), n.year, o.year) AS year, coalesce(nullif(o.citation_count, 0), n.citation_count, o.citation_count) AS citation_count FROM o FULL JOIN n ON o.arxiv_id = n.arxiv_id",
    "ups9_latest": "SELECT arxiv_id, rec_id, citation_count FROM papers WHERE arxiv_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY ingested_at DESC, rec_id DESC) = 1",
    "ded3_tiers": f"WITH a AS (SELECT *, {_RICH} AS f, length(coalesce(abstract, '')) AS la, coalesce(citation_count, -1) AS cc FROM papers), b AS (SELECT * REPLACE (mc AS citation_count) FROM (SELECT *, max(citation_count) OVER w1 AS mc, row_number() OVER (PARTITION BY coalesce(arxiv_id, rec_id::VARCHAR || '#') ORDER BY f DESC, la DESC, cc DESC, rec_id) AS rn FROM a WINDOW w1 AS (PARTITION BY coalesce(arxiv_id, rec_id::VARCHAR || '#'))) WHERE rn = 1) SELECT rec_id, arxiv_id, mc2 AS citation_count FROM (SELECT *, max(citation_count) OVER (PARTITION BY coalesce({_DOI}, rec_id::VARCHAR || '#')) AS mc2, row_number() OVER (PARTITION BY coalesce({_DOI}, rec_id::VARCHAR || '#') ORDER BY f DESC, la DESC, cc DESC, rec_id) AS rn2 FROM b) WHERE rn2 = 1",
    "ded2_first_source": f"SELECT key, rec_id FROM (SELECT coalesce(arxiv_id, {_DOI}, {_PLAIN}) AS key, rec_id, ingested_at FROM papers) WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ingested_at, rec_id) = 1",
    "ded1_topics_union": "SELECT arxiv_id, min(rec_id) AS rec_id, coalesce(array_to_string(list_sort(list(DISTINCT lower(trim(source))) FILTER (source IS NOT NULL)), ';'), '') AS sources FROM papers WHERE arxiv_id IS NOT NULL GROUP BY 1",
    "dat3_year_bands": f"SELECT {_BAND} AS band, count(*) AS n FROM papers GROUP BY 1",
    "win9_allocation": f"WITH s AS (SELECT {_BAND} AS band, coalesce(lower(trim(source)), 'none') AS src, count(*) AS n FROM papers GROUP BY 1, 2) SELECT band, src, least(n, greatest(1, round(200 * n / (SELECT count(*) FROM papers)::DOUBLE)))::BIGINT AS taken FROM s",
    "sig1_sig2_sig3_signals": f"SELECT rec_id, round({_RECENCY}, 6) AS recency, round({_CITATION}, 6) AS citation, round({_VELOCITY}, 6) AS velocity FROM (SELECT *, {_YY} AS yy FROM papers)",
    "src5_export": "SELECT arxiv_id, rec_id, lpad(year::VARCHAR, 4, '0') || '-01-01' AS published_date, coalesce(citation_count, 0) AS citations FROM papers WHERE arxiv_id IS NOT NULL",
    "set2_existing_ids": r"SELECT DISTINCT id FROM (SELECT regexp_extract(arxiv_id, '^(\d{4}\.\d{4,5})(v\d+)?$', 1) AS id FROM papers UNION ALL SELECT regexp_extract(arxiv_id, '^(\d{4}\.\d{4,5})(v\d+)?$', 1) FROM fetch_status) WHERE id <> ''",
    "set1_set3_reconcile": "SELECT DISTINCT arxiv_id, 'fetched' AS only_in FROM fetch_status WHERE arxiv_id NOT IN (SELECT arxiv_id FROM papers WHERE arxiv_id IS NOT NULL) UNION ALL SELECT DISTINCT arxiv_id, 'catalog' FROM papers WHERE arxiv_id IS NOT NULL AND arxiv_id NOT IN (SELECT arxiv_id FROM fetch_status)",
}
