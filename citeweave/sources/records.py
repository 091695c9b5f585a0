"""Readers and writers: corpus JSON, feed XML, nested API records, labels, bibliographies, HTML pages.

Files go through Spark's own sources with declared schemas; nested records become flat ones with built-in functions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import vectors
from citeweave.functions.ids import arxiv_id
from citeweave.operators.graph import key_sql, keyed
from citeweave.session import checkpoint_folder, table

PAPER = "arxiv_id string, title string, abstract string, authors array<string>, categories array<string>, published_date string, citation_count string, doi string"
WORK = "id string, doi string, display_name string, publication_year int, cited_by_count long, abstract_inverted_index map<string, array<int>>, concepts array<struct<display_name: string>>, ids struct<openalex: string>"
NODE = "paperId string, title string, abstract string, year int, citationCount long, externalIds struct<ArXiv: string, DOI: string>, authors array<struct<name: string>>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of papers; rows that do not fit the schema fail the job."""
    return spark.read.schema(PAPER).option("multiLine", True).option("mode", "FAILFAST").json(path)


def save_corpus(corpus: DataFrame, path: str) -> None:
    """Writes papers as JSON, a line each, in as many files as there are partitions; read_corpus_lines reads them."""
    corpus.write.mode("overwrite").json(path)


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """What save_corpus wrote: files are split among tasks, unlike those of one array."""
    return spark.read.schema(PAPER).option("mode", "FAILFAST").json(path)


def corpus_rows(corpus: DataFrame) -> DataFrame:
    """Catalog rows of a corpus: cleaned ids, year from the date, counts only where all digits, blank-free categories."""
    return corpus.select(
        arxiv_id(F.col("arxiv_id")).alias("arxiv_id"), F.trim("title").alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.substring("published_date", 1, 4).try_cast("int").alias("year"), F.when(F.col("citation_count").rlike(r"^\d+$"), F.col("citation_count").try_cast("int")).alias("citation_count"),
        F.filter(F.transform("categories", lambda c: F.trim(c)), lambda c: c != "").alias("categories"), "doi",
    ).where("arxiv_id is not null")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed: blanks collapsed, the primary category first, categories distinct."""
    schema = "id string, title string, summary string, published string, author array<struct<name: string>>, category array<struct<_term: string>>, primary_category struct<_term: string>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    cats = F.array_distinct(F.array_compact(F.concat(F.array(F.col("primary_category._term")), F.transform("category", lambda c: c["_term"]))))
    return raw.select(arxiv_id(F.col("id")).alias("arxiv_id"), flat(F.col("title")).alias("title"), flat(F.col("summary")).alias("abstract"), F.transform("author", lambda a: a["name"]).alias("authors"), cats.alias("categories"), F.substring("published", 1, 10).alias("published_date"))


def inverted_abstract(index: Column) -> Column:
    """Text of a word -> positions map in order of position; gaps vanish, of words at one position the last counts."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def work_rows(works: DataFrame) -> DataFrame:
    """Nested works (see WORK) as catalog rows; at most 8 concepts are categories."""
    doi = F.lower(F.regexp_replace("doi", r"^https?://(dx\.)?doi\.org/", ""))
    return works.select(
        F.concat(F.lit("openalex:"), F.element_at(F.split("id", "/"), -1)).alias("canonical_id"), doi.alias("doi"), F.col("display_name").alias("title"), F.col("publication_year").alias("year"),
        F.col("cited_by_count").alias("citation_count"), inverted_abstract(F.col("abstract_inverted_index")).alias("abstract"), F.array_compact(F.transform(F.slice("concepts", 1, 8), lambda c: c["display_name"])).alias("categories"),
    )


def node_rows(nodes: DataFrame) -> DataFrame:
    """Nested paper nodes (see NODE) as catalog rows; the id cascade is arXiv, own id, DOI."""
    ax = arxiv_id(F.col("externalIds.ArXiv"))
    cid = F.coalesce(F.concat(F.lit("arxiv:"), ax), F.concat(F.lit("s2:"), F.col("paperId")), F.concat(F.lit("doi:"), F.lower("externalIds.DOI")))
    return nodes.select(cid.alias("canonical_id"), ax.alias("arxiv_id"), "title", "abstract", "year", F.col("citationCount").alias("citation_count"), F.transform("authors", lambda a: a["name"]).alias("authors"), (F.length(F.trim(F.coalesce("abstract", F.lit("")))) > 0).alias("has_abstract"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Personal rankings from CSV: (paper_id, title, score), columns under any of their usual names; scores outside 1..5 and repeated ids fail."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in raw.columns}
    pick = lambda *xs: F.coalesce(*[F.col(names[x]) for x in xs if x in names], F.lit(None).cast("string"))
    score = pick("score_1_to_5", "score", "rating").try_cast("double")
    df = raw.select(F.coalesce(arxiv_id(pick("arxiv_id")), pick("paper_id", "id")).alias("paper_id"), pick("title").alias("title"), score.alias("score")).where("paper_id is not null")
    ok = F.coalesce(F.col("score").between(1, 5), F.lit(False))
    twice = df.groupBy("paper_id").agg(F.count("*").alias("n"), F.first("title").alias("title"), F.first("score").alias("score"))
    return twice.select("paper_id", "title", F.when((F.col("n") == 1) & ok, F.col("score")).otherwise(F.raise_error(F.lit("a score is outside 1..5 or an id is repeated"))).alias("score"))


def bibliography(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, position, canonical_id, title, year): the items of a page's bibliography, each id once; items without an id get a hash of their text.

    Items shorter than 15 characters are dropped.
    """
    items = pages.select(page, F.posexplode(F.regexp_extract_all(html, F.lit(r'(?s)<li[^>]*class="[^"]*ltx_bibitem[^"]*"[^>]*>(.*?)</li>'), 1)).alias("position", "raw"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]+>", " "), r"\s+", " "))
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    ax = F.regexp_extract("raw", r"arxiv\.org/abs/(\d{4}\.\d{4,5})", 1)
    doi = F.lower(F.regexp_extract("raw", r'doi\.org/(10\.[^"<>\s]+)', 1))
    items = items.withColumn("title", plain).where(F.length("title") >= 15)
    cid = F.when(ax != "", F.concat(F.lit("arxiv:"), ax)).when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("raw:"), F.substring(F.sha1("title"), 1, 16)))
    got = items.select(page, "position", cid.alias("canonical_id"), "title", F.regexp_extract("title", r"\b((?:19|20)\d{2})\b", 1).try_cast("int").alias("year"))
    return got.groupBy(page, "canonical_id").agg(F.min("position").alias("position"), F.min_by("title", "position").alias("title"), F.min_by("year", "position").alias("year"))


_SKIP = {"script", "style", "nav", "header", "footer", "aside"}


class _Page(HTMLParser):
    """Sections of a page: text under each section id, formulas from alt texts, list items with bullets."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.math, self.heading, self.buffer = 0, 0, "", []
        self.name, self.found, self.title, self.in_heading = "front_matter", [], "", None

    def flush(self):
        body = re.sub(r"[ \t]+", " ", "".join(self.buffer))
        body = re.sub(r"\s*\n\s*", "\n", body).strip()
        if len(body) >= 80:
            self.found.append((self.name, self.heading, body))
        self.buffer = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        if self.skip:
            return
        if tag == "section":
            self.flush()
            self.name, self.heading = a.get("id") or self.name, ""
        elif tag == "math":
            self.math += 1
            mark = "$$" if a.get("display") == "block" else "$"
            self.buffer.append(f"{mark}{a.get('alttext', '')}{mark}")
        elif re.fullmatch("h[1-6]", tag):
            self.in_heading = []
        elif tag == "li":
            self.buffer.append("\n- ")
        elif tag in ("p", "div", "br", "tr"):
            self.buffer.append("\n")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "math":
            self.math = max(0, self.math - 1)
        elif re.fullmatch("h[1-6]", tag) and self.in_heading is not None:
            words = " ".join("".join(self.in_heading).split())
            if tag == "h1":
                self.title = self.title or words
            elif tag == "h6":
                self.buffer.append(f"\n**{words}** ")
            else:
                self.heading = self.heading or words
            self.in_heading = None

    def handle_data(self, data):
        if self.skip or self.math:
            return
        (self.in_heading if self.in_heading is not None else self.buffer).append(data)


def page_sections(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, title, section_id, heading, text): the sections of at least 80 characters of each HTML page; a page without a heading is Untitled."""
    kind = dict(pages.dtypes)[page]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["i"], b["t"]):
                p = _Page()
                p.feed(t)
                p.close()
                p.flush()
                rows += [(i, p.title or "Untitled", *s) for s in p.found]
            yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate((page, "title", "section_id", "heading", "text"))})

    return pages.select(F.col(page).alias("i"), F.col(html).alias("t")).where("t is not null").mapInPandas(run, f"`{page}` {kind}, title string, section_id string, heading string, text string")


def cache_key(url: Column, params: Column) -> Column:
    """url and its parameters (a map) in key order."""
    parts = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws("?", url, F.array_join(parts, "&"))


def first_tier(tiers: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first input that has the key; inputs share their columns. `tier` says which."""
    every = None
    for i, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(i))
        every = t if every is None else every.unionByName(t)
    low = every.groupBy(key).agg(F.min("tier").alias("_low"))
    return every.join(low, key).where("tier = _low").drop("_low")


def arxiv_clauses(words: Column) -> Column:
    """A search expression: up to six tokens joined by AND."""
    return F.array_join(F.transform(F.slice(words, 1, 6), lambda w: F.concat(F.lit("all:"), w)), " AND ")


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/source-{uuid.uuid4().hex}"


def _q_corpus(spark, d):
    """The catalog saved as a corpus, read again and turned into catalog rows."""
    p = table(spark, d, "papers")
    date = F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), F.lit("-01-01"))
    corpus = p.select("arxiv_id", "title", "abstract", date.alias("published_date"), F.col("citation_count").cast("string").alias("citation_count"), F.array(F.coalesce("source", F.lit(" "))).alias("categories"), "doi")
    path = _scratch(spark)
    save_corpus(corpus, path)
    rows = corpus_rows(read_corpus_lines(spark, path))
    return rows.groupBy("arxiv_id").agg(F.count("*").alias("n"), F.max("year").alias("year"), F.sum("citation_count").alias("citations"), F.max(F.length("abstract")).alias("longest"), F.sum(F.size("categories")).cast("long").alias("categories"))


def _q_feed(spark, d):
    """The catalog written as Atom entries and read again."""
    p = table(spark, d, "papers").where("arxiv_id is not null and title is not null")
    entry = p.select(F.concat(F.lit("http://arxiv.org/abs/"), "arxiv_id", F.lit("v1")).alias("id"), "title", F.coalesce("abstract", F.lit("none")).alias("summary"), F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), F.lit("-01-01T00:00:00Z")).alias("published"), F.array(F.struct(F.lit("cs.LG").alias("_term"))).alias("category"))
    path = _scratch(spark)
    entry.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)
    return read_feed(spark, path).groupBy("arxiv_id").agg(F.count("*").alias("n"), F.max("published_date").alias("published"))


def _q_nodes(spark, d):
    p = table(spark, d, "papers")
    ids, no_names = F.struct(F.col("arxiv_id").alias("ArXiv"), F.col("doi").alias("DOI")), F.array(F.struct(F.lit("n").alias("name")))
    node = p.select("rec_id", F.col("s2_id").alias("paperId"), "title", "abstract", "year", F.col("citation_count").cast("long").alias("citationCount"), ids.alias("externalIds"), no_names.alias("authors"))
    return node_rows(node).groupBy("canonical_id").agg(F.count("*").alias("n"), F.count_if("has_abstract").alias("with_abstract"), F.max("citation_count").alias("citations"))


def _q_works(spark, d):
    p = table(spark, d, "papers").where("abstract is not null")
    w = F.filter(F.split(F.trim("abstract"), " +"), lambda x: x != "")
    index = F.map_from_entries(F.transform(F.array_distinct(w), lambda x: F.struct(x, F.filter(F.transform(w, lambda y, i: F.when(y == x, i)), lambda i: i.isNotNull()))))
    work = p.select(F.concat(F.lit("https://openalex.org/W"), "rec_id").alias("id"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"), F.col("citation_count").cast("long").alias("cited_by_count"), index.alias("abstract_inverted_index"), F.array(F.struct(F.lower(F.trim("source")).alias("display_name"))).alias("concepts"))
    return work_rows(work).select("canonical_id", "doi", "year", "citation_count", "abstract", F.array_join("categories", ";").alias("categories"))


def _q_labels(spark, d):
    """A ranking saved as CSV and read again."""
    path = _scratch(spark)
    p = table(spark, d, "papers").select(F.concat(F.lit("p"), "rec_id").alias("paper_id"), F.coalesce(F.regexp_replace("title", r"[\r\n]", " "), F.lit("")).alias("title"), (1 + F.col("rec_id") % 5).alias("score"))
    p.write.option("header", True).csv(path)
    return read_labels(spark, path).groupBy("score").agg(F.count("*").alias("n"))


def _q_bibliography(spark, d):
    """Bibliographies made of each paper's references, taken out of the page again."""
    r = table(spark, d, "ref_edges").where("trim(ref_id) != ''")
    arxiv = arxiv_id(F.col("ref_id"))
    item = F.concat(F.lit('<li class="ltx_bibitem">J. Doe, a reference of 2021: '), F.coalesce(F.concat(F.lit('<a href="https://arxiv.org/abs/'), arxiv, F.lit('">x</a>')), F.translate("ref_id", "<>&;", "    ")), F.lit("</li>"))
    page = r.groupBy("focal_id").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("html"))
    return bibliography(page, "focal_id", "html").groupBy("focal_id").agg(F.count("*").alias("items"), F.count_if(F.col("canonical_id").startswith("arxiv:")).alias("arxiv"), F.max("year").alias("year"))


def upserted(old: DataFrame, new: DataFrame, key: list[str], vec: str, at: str) -> DataFrame:
    """A vector collection (key, vec, at) with new rows put in: of each key the latest counts, of equally late ones the new.

    A collection has one length of vectors, that of most of its old rows (the smaller on ties): rows of another length
    and null vectors are refused, old ones too.
    """
    size = old.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("_d")).agg(F.count("*").alias("_n")).agg(F.max(F.struct("_n", (-F.col("_d")).alias("d"))).alias("m")).select((-F.col("m.d")).alias("_dim"))  # one row
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).crossJoin(F.broadcast(size)).where(F.size(vec) == F.col("_dim"))
    rest = [c for c in old.columns if c not in key]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull(), at, "_new")).alias("_r"))
    return best.select(*key, *(F.col("_r")[c].alias(c) for c in rest))


def _q_upserted(spark, d):
    """Vectors of the smaller model embedded up to 2025 as the collection, all others of any model as the update."""
    v = table(spark, d, "paper_vectors").where("trim(canonical_id) != ''").select("canonical_id", "vec_id", "vector", "embedded_at", "model")
    v = v.groupBy("canonical_id", "embedded_at", "model").agg(F.min_by(F.struct("vec_id", "vector"), "vec_id").alias("s")).select("canonical_id", "s.vec_id", "s.vector", "embedded_at", "model")
    first = (F.col("model") == "mini-embed-64") & (F.coalesce("embedded_at", F.lit("2100-01-01").cast("timestamp")) < "2025-01-01")
    got = upserted(v.where(first).drop("model"), v.where(~F.coalesce(first, F.lit(False))).drop("model"), ["canonical_id"], "vector", "embedded_at")
    return got.select("canonical_id", F.size("vector").cast("long").alias("dim"), F.date_format("embedded_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def _q_to_ingest(spark, d):
    """The ids of the 80 papers highest in the ranking by citations that have no document yet."""
    p = keyed(table(spark, d, "papers").select("canonical_id", "citation_count"), "canonical_id").where("canonical_id is not null").groupBy("canonical_id").agg(F.max(F.coalesce("citation_count", F.lit(0))).alias("citations"))
    have = keyed(table(spark, d, "documents").select("canonical_id"), "canonical_id").where("canonical_id is not null").select("canonical_id")
    return p.join(have, "canonical_id", "left_anti").orderBy(F.desc("citations"), "canonical_id").limit(80)


def _q_weights(spark, d):
    """The weights of each mix clamped at 0 and divided by their sum, to 4 decimals."""
    t = table(spark, d, "mix_targets").where("mix is not null").withColumn("w", F.greatest(F.lit(0.0), F.coalesce("target_weight", F.lit(0.0))))
    total = t.groupBy("mix").agg(F.sum("w").alias("total"))
    return t.join(total, "mix").select("mix", "source", F.when(F.col("total") > 0, F.round(F.col("w") / F.col("total"), 4)).alias("weight"))


def _q_units(spark, d):
    """Vectors with non-finite components scrubbed, brought to unit length."""
    u = vectors.unit(F.col("vector"))
    return table(spark, d, "paper_vectors").where("vector is not null").select("vec_id", F.round(vectors.norm(u), 6).alias("norm"), F.round(F.aggregate(u, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _q_sections(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return page_sections(docs, "doc_id", "text")


def _q_sql_sections(spark, d):
    """Plain text of marked-up documents without Python: tags dropped, blanks collapsed."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.trim(F.regexp_replace(F.regexp_replace("text", "<[^>]+>", " "), r"[ \n\t]+", " ")).alias("plain"), F.size(F.regexp_extract_all("text", F.lit("<p>"), 0)).cast("long").alias("paragraphs"))


def _q_tiers(spark, d):
    """Each paper's references from the first source that has any."""
    r = table(spark, d, "ref_edges").select("focal_id", "ref_id", F.coalesce("source_api", F.lit("none")).alias("source_api"))
    tiers = [r.where(F.col("source_api") == s) for s in ("s2", "openalex", "arxiv_html", "none")]
    return first_tier(tiers, "focal_id").groupBy("focal_id", "source_api", "tier").agg(F.count("*").alias("n_refs"))


def _q_clauses(spark, d):
    w = F.filter(F.split(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+"), lambda x: F.length(x) > 3)
    return table(spark, d, "papers").select("rec_id", arxiv_clauses(w).alias("clause"))


def _q_cache_keys(spark, d):
    e = table(spark, d, "events")
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.lit("type"), F.col("event_type"))
    return e.select("event_id", cache_key(F.lit("https://api.example/x"), params).alias("key"))


def _q_export(spark, d):
    """Papers with nested enrichment and sources as one JSON line each, in one job."""
    p = table(spark, d, "papers").where("arxiv_id is not null")
    src = p.groupBy("arxiv_id").agg(F.array_sort(F.collect_set(F.lower(F.trim("source")))).alias("sources"), F.min("rec_id").alias("rec_id"))
    s = table(spark, d, "fetch_status").select("arxiv_id", F.struct("status", "n_refs").alias("fetch"))
    j = src.join(s, "arxiv_id", "left").select("arxiv_id", F.to_json(F.struct("arxiv_id", "rec_id", "sources", "fetch")).alias("line"))
    return j.select("arxiv_id", F.get_json_object("line", "$.fetch.status").alias("status"), F.get_json_object("line", "$.rec_id").cast("long").alias("rec_id"))


def _q_inverted(spark, d):
    """Abstracts turned into word -> positions maps and back."""
    p = table(spark, d, "papers").where("abstract is not null")
    w = F.split(F.trim("abstract"), " +")
    entries = F.transform(F.array_distinct(w), lambda x: F.struct(x.alias("k"), F.filter(F.transform(w, lambda y, i: F.when(y == x, i)), lambda i: i.isNotNull()).alias("v")))
    return p.select("rec_id", inverted_abstract(F.map_from_entries(entries)).alias("abstract"))


QUERIES = {
    "src1_src4_src6_corpus": _q_corpus,
    "src7_feed": _q_feed,
    "src10_src13_nodes": _q_nodes,
    "src11_works": _q_works,
    "src24_labels": _q_labels,
    "src17_bibliography": _q_bibliography,
    "src23_upserted_vectors": _q_upserted,
    "src25_to_ingest": _q_to_ingest,
    "mth3_weights": _q_weights,
    "arr2_units": _q_units,
    "src18_src19_page_sections": _q_sections,
    "src18_plain_text": _q_sql_sections,
    "src14_first_tier": _q_tiers,
    "src8_src9_clauses": _q_clauses,
    "src30_cache_keys": _q_cache_keys,
    "src28_src29_export": _q_export,
    "src12_inverted_abstract": _q_inverted,
}
_AX = r"(?i)^(?:arxiv: *)?(\d{4}\.\d{4,5})(?:v\d+)?$"
SQL = {
    "src1_src4_src6_corpus": f"SELECT regexp_extract(trim(arxiv_id), '{_AX}', 1) AS arxiv_id, count(*) AS n, max(try_cast(lpad(year::VARCHAR, 4, '0') AS INT)) AS year, sum(CASE WHEN citation_count >= 0 THEN citation_count END)::BIGINT AS citations, max(length(coalesce(abstract, ''))) AS longest, sum((trim(coalesce(source, ' ')) <> '')::INT)::BIGINT AS categories FROM papers WHERE arxiv_id IS NOT NULL GROUP BY 1",
    "src7_feed": f"SELECT regexp_extract(trim(arxiv_id), '{_AX}', 1) AS arxiv_id, count(*) AS n, max(lpad(year::VARCHAR, 4, '0') || '-01-01') AS published FROM papers WHERE arxiv_id IS NOT NULL AND title IS NOT NULL GROUP BY 1",
    "src10_src13_nodes": f"SELECT coalesce('arxiv:' || nullif(regexp_extract(trim(arxiv_id), '{_AX}', 1), ''), 's2:' || s2_id, 'doi:' || lower(doi)) AS canonical_id, count(*) AS n, count(*) FILTER (trim(coalesce(abstract, '')) <> '') AS with_abstract, max(citation_count)::BIGINT AS citations FROM papers GROUP BY 1",
    "src11_works": r"SELECT 'openalex:W' || rec_id AS canonical_id, lower(doi) AS doi, year, citation_count::BIGINT AS citation_count, array_to_string(list_filter(regexp_split_to_array(trim(abstract), ' +'), lambda x: x <> ''), ' ') AS abstract, coalesce(lower(trim(source)), '') AS categories FROM papers WHERE abstract IS NOT NULL",
    "src17_bibliography": f"WITH r AS (SELECT focal_id, trim(ref_id) AS t, translate(ref_id, '<>&;', '    ') AS raw, regexp_extract(trim(ref_id), '(?i)^(?:https?://(?:www\\.)?arxiv\\.org/(?:abs|pdf)/|arxiv: *)?(\\d{{4}}\\.\\d{{4,5}})(?:v\\d+)?(?:\\.pdf)?$', 1) AS ax FROM ref_edges WHERE trim(ref_id) <> ''), i AS (SELECT DISTINCT focal_id, CASE WHEN ax <> '' THEN 'arxiv:' || ax ELSE 'raw:' || trim(regexp_replace('J. Doe, a reference of 2021: ' || raw, '\\s+', ' ', 'g')) END AS id FROM r) SELECT focal_id, count(*) AS items, count(*) FILTER (starts_with(id, 'arxiv:')) AS arxiv, 2021 AS year FROM i GROUP BY 1",
    "src24_labels": "SELECT (1 + rec_id % 5)::DOUBLE AS score, count(*) AS n FROM papers GROUP BY 1",
    "src23_upserted_vectors": "WITH v AS (SELECT canonical_id, embedded_at, model, arg_min(vector, vec_id) AS vector FROM paper_vectors WHERE trim(canonical_id) <> '' GROUP BY 1, 2, 3), w AS (SELECT *, coalesce(model = 'mini-embed-64' AND embedded_at < TIMESTAMP '2025-01-01', false) AS old FROM v), z AS (SELECT len(vector) AS d FROM w WHERE old AND vector IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, d LIMIT 1) SELECT canonical_id, len(vector) AS dim, strftime(embedded_at, '%Y-%m-%d %H:%M:%S') AS at FROM w, z WHERE len(vector) = d QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY embedded_at DESC NULLS LAST, old) = 1",
    "src25_to_ingest": f"SELECT canonical_id, max(coalesce(citation_count, 0)) AS citations FROM (SELECT {key_sql('canonical_id')} AS canonical_id, citation_count FROM papers) WHERE canonical_id IS NOT NULL AND canonical_id NOT IN (SELECT k FROM (SELECT {key_sql('canonical_id')} AS k FROM documents) WHERE k IS NOT NULL) GROUP BY 1 ORDER BY citations DESC, canonical_id LIMIT 80",
    "mth3_weights": "SELECT mix, source, round(greatest(0, coalesce(target_weight, 0)) / sum(greatest(0, coalesce(target_weight, 0))) OVER (PARTITION BY mix), 4) AS weight FROM mix_targets",
    "arr2_units": "WITH c AS (SELECT vec_id, list_transform(vector, lambda x: CASE WHEN x IS NOT NULL AND isfinite(x) THEN x::DOUBLE ELSE 0 END) AS v FROM paper_vectors WHERE vector IS NOT NULL), n AS (SELECT *, CASE WHEN len(v) > 0 THEN sqrt(list_inner_product(v, v)) ELSE 0 END AS n FROM c) SELECT vec_id, CASE WHEN n < 1e-12 THEN 0 ELSE 1 END::DOUBLE AS norm, CASE WHEN n < 1e-12 THEN 0 ELSE round(list_sum(v) / n, 6) END AS total FROM n",
    "src18_plain_text": "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \\n\\t]+', ' ', 'g')) AS plain, len(regexp_extract_all(text, '<p>')) AS paragraphs FROM documents WHERE text IS NOT NULL",
    "src14_first_tier": "WITH r AS (SELECT focal_id, coalesce(source_api, 'none') AS source_api, CASE coalesce(source_api, 'none') WHEN 's2' THEN 0 WHEN 'openalex' THEN 1 WHEN 'arxiv_html' THEN 2 WHEN 'none' THEN 3 END AS tier FROM ref_edges) SELECT focal_id, source_api, tier, count(*) AS n_refs FROM (SELECT *, min(tier) OVER (PARTITION BY focal_id) AS lo FROM r) WHERE tier = lo GROUP BY 1, 2, 3",
    "src8_src9_clauses": "SELECT rec_id, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda x: length(x) > 3)[:6], lambda x: 'all:' || x), ' AND ') AS clause FROM papers",
    "src30_cache_keys": "SELECT event_id, 'https://api.example/x?k=' || coalesce(props->>'$.k', '') || '&type=' || event_type || '&user=' || user_id AS key FROM events",
    "src28_src29_export": "SELECT p.arxiv_id, s.status, min(p.rec_id) AS rec_id FROM papers p LEFT JOIN fetch_status s ON s.arxiv_id = p.arxiv_id WHERE p.arxiv_id IS NOT NULL GROUP BY 1, 2",
    "src12_inverted_abstract": "SELECT rec_id, regexp_replace(trim(abstract), ' +', ' ', 'g') AS abstract FROM papers WHERE abstract IS NOT NULL",
}
