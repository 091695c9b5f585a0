"""Lexical and dense retrieval over passages: BM25, rank fusion, diversity, context packing, answer cache.

All queries run as one job with the pool (or query) id in every key; statistics are over the pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text, vectors
from citeweave.functions.skew import among, hot_keys, lookup, row_numbers
from citeweave.operators.dense import top_similar
from citeweave.operators.graph import key_sql, keyed
from citeweave.session import cut, spread, table

# Fixed values.
NAMED = r"\b(\d{4}\.\d{4,5})(?:v\d+)?"
K1, B, RRF_K, ID_BOOST, ENTITY_BOOST = 1.5, 0.75, 60, 0.05, 0.025
KEYWORDS, ENTITIES, POOL = 4, 4, 40
ENTITY_STOP = [
    "what", "how", "why", "when", "where", "who", "which", "is", "are", "the", "of", "in", "and", "or", "to", "for", "with", "a", "an", "paper", "papers", "method", "approach", "model", "explain", "main",
    "contribution", "summary", "does", "do", "used", "can", "using", "work", "novel", "result", "results",
]


def pool_bm25(rows: DataFrame, pool: str, doc: str, words: Column, asked: Column, keep: list[str] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(pool, doc, keep, bm25): the score of each passage, null where it shares no term with its pool's query.

    words are the tokens of a row's passage, asked those of its pool's query; a term asked twice counts twice. idf is
    ln(1 + (N - df + .5) / (df + .5)) over the pool. Texts are cut into tokens once; only tokens that are asked for are
    counted over the pool, and a pool's statistics are one row, joined with hot pools salted.
    """
    keep = keep or []
    r = rows.select(pool, doc, *keep, words.alias("_w"), asked.alias("asked"))
    r = cut(r.select(pool, doc, *keep, "asked", F.size("_w").alias("_len"), F.filter("_w", lambda x: F.array_contains("asked", x)).alias("hits")))
    df = r.select(pool, F.explode(F.array_distinct("hits")).alias("t")).groupBy(pool, "t").agg(F.count("*").alias("df"))
    df = df.groupBy(pool).agg(F.map_from_entries(F.collect_list(F.struct("t", "df"))).alias("_df"))  # the terms of one query
    stats = r.groupBy(pool).agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg")).join(df, pool)
    hit = lookup(r, stats, [pool], F.col(doc))
    count = lambda words, t: F.size(F.filter(words, lambda x: x == t))

    def gain(t: Column) -> Column:
        tf, n = count(F.col("hits"), t), F.col("_df")[t]
        idf = F.log1p((F.col("_n") - n + 0.5) / (n + 0.5))
        return count(F.col("asked"), t) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))

    return hit.select(pool, doc, *keep, F.when(F.size("hits") > 0, F.aggregate(F.array_distinct("hits"), F.lit(0.0), lambda s, t: s + gain(t))).alias("bm25"))


def fused(scored: DataFrame, pool: list[str], doc: str, rrf_k: int = RRF_K) -> DataFrame:
    """scored (pool, doc, dense, bm25, boost) with dense_rank, bm25_rank, rrf and rank; ties by dense rank, then doc.

    Pools with more than a share of all rows are ranked in parts.
    """
    base = cut(scored)
    hot = hot_keys(base, pool, F.col(doc))
    out = None
    for keys, df in [(hot, base.where(among(pool, hot)))] * bool(hot) + [([], base.where(~among(pool, hot)) if hot else base)]:
        df = row_numbers(df, pool, [F.desc("dense"), F.col(doc)], "dense_rank", keys)
        df = row_numbers(df, pool, [F.desc("bm25"), F.col("dense_rank")], "bm25_rank", keys)
        rrf = 1.0 / (rrf_k + F.col("dense_rank")) + 1.0 / (rrf_k + F.col("bm25_rank")) + F.col("boost")
        df = row_numbers(df.withColumn("rrf", F.round(rrf, 9)), pool, [F.desc("rrf"), F.col("dense_rank")], "rank", keys)
        out = df if out is None else out.unionByName(df)
    return out


def entities(asked: DataFrame, titles: DataFrame, query: str, words: str, paper: str, title: str, limit: int = ENTITIES, k1: float = 1.2, b: float = B) -> DataFrame:
    """(query, paper, score, place): the papers whose titles hold a keyword of the query, best first.

    Keywords are the first KEYWORDS tokens of more than two characters that are no stop words; a keyword of several
    parts must be in the title as a phrase. Titles are scored by BM25 over the keywords; ties go to the smaller paper.
    """
    q = asked.select(query, F.posexplode(F.slice(F.filter(F.regexp_extract_all(words, F.lit(r"\b[A-Za-z0-9_.\-]+\b"), 0), lambda t: (F.length(t) > 2) & ~F.lower(t).isin(ENTITY_STOP)), 1, KEYWORDS)).alias("_p", "_k"))
    q = q.withColumn("_k", text.plain_title(F.col("_k"))).where("_k != ''")
    t = titles.select(paper, text.plain_title(F.col(title)).alias("_t")).withColumn("_l", F.size(F.split("_t", " ")))
    stats = t.agg(F.count("*").alias("_n"), F.avg("_l").alias("_avg"))
    terms = q.select("_k").distinct().withColumn("_w", F.substring_index("_k", " ", 1))
    inside = F.expr("contains(concat(' ', _t, ' '), concat(' ', _k, ' '))")
    found = t.withColumn("_w", F.explode(F.array_distinct(F.split("_t", " ")))).join(terms, "_w").where(inside)
    tf = (F.length(F.concat(F.lit(" "), F.replace(F.col("_t"), F.lit(" "), F.lit("  ")), F.lit(" "))) - F.length(F.replace(F.concat(F.lit(" "), F.replace(F.col("_t"), F.lit(" "), F.lit("  ")), F.lit(" ")), F.concat(F.lit(" "), F.replace(F.col("_k"), F.lit(" "), F.lit("  ")), F.lit(" ")), F.lit("")))) / (F.length(F.replace(F.col("_k"), F.lit(" "), F.lit("  "))) + 2)
    hits = found.select("_k", paper, "_l", tf.alias("_tf"))
    df = hits.groupBy("_k").agg(F.count("*").alias("_df"))
    idf = F.log1p((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    gain = idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_l") / F.col("_avg")))
    scored = hits.join(df, "_k").crossJoin(F.broadcast(stats)).select("_k", paper, gain.alias("_g"))  # one row
    got = q.join(scored, "_k").groupBy(query, paper).agg(F.round(F.sum("_g"), 9).alias("score"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), paper)
    return got.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def diverse(ranked: DataFrame, pool: list[str], paper: str, section: str, cap: int = 3, lone: bool = False) -> DataFrame:
    """The best passage of each (paper, section), at most `cap` per paper; with `lone`, pools of a single paper have no cap."""
    one = Window.partitionBy(*pool, paper, section).orderBy("rank")
    top = Window.partitionBy(*pool, paper).orderBy("rank")
    kept = ranked.withColumn("_s", F.row_number().over(one)).where("_s = 1").withColumn("_p", F.row_number().over(top))
    if not lone:
        return kept.where(F.col("_p") <= cap).drop("_s", "_p")
    whole = Window.partitionBy(*pool)
    many = F.coalesce(F.min(paper).over(whole) != F.max(paper).over(whole), F.lit(False))
    return kept.withColumn("_many", many).where(~F.col("_many") | (F.col("_p") <= cap)).drop("_s", "_p", "_many")


def packed(ranked: DataFrame, pool: list[str], length: str, budget: int = 12_000) -> DataFrame:
    """Passages in rank order up to the first that overflows the budget; the first is always kept."""
    w = Window.partitionBy(*pool).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    some = ranked.where((F.col("rank") <= budget) | (F.col(length) <= 0))  # no later passage of a character or more can fit
    return some.withColumn("_run", F.sum(length).over(w)).where((F.col("_run") <= budget) | (F.col("rank") == 1)).drop("_run")


def cache_hits(asked: DataFrame, cache: DataFrame, scope: list[str], threshold: float = 0.92) -> DataFrame:
    """(id, hit, similarity): the most similar earlier entry of the same scope, from the threshold on; the earliest wins ties.

    Both have (id, vec, scope columns); vectors of different size are not compared. Equal vectors of a scope are
    compared once, as their earliest entry; questions of hot scopes are spread over many tasks.
    """
    c = cache.groupBy(*scope, F.col("vec").alias("_v")).agg(F.min("id").alias("hit"))
    both = lookup(asked, c, scope, F.col("id"), "inner").where((F.col("hit") < F.col("id")) & (F.size("vec") == F.size("_v")))
    sim = both.select("id", "hit", F.round(vectors.dot(vectors.unit(F.col("vec")), vectors.unit(F.col("_v"))), 9).alias("s")).where(F.col("s") >= threshold)
    return sim.groupBy("id").agg(F.max(F.struct("s", (-F.col("hit")).alias("h"))).alias("m")).select("id", (-F.col("m.h")).alias("hit"), F.col("m.s").alias("similarity"))


def _docs(spark, d: str) -> DataFrame:
    """Passages with the paper they belong to, spelled in one way."""
    return keyed(table(spark, d, "documents").select("doc_id", "text", "canonical_id", "section"), "canonical_id").where("canonical_id is not null and trim(text) != ''")


def _titles(spark, d: str) -> DataFrame:
    """One title per paper: that of its first record."""
    p = keyed(table(spark, d, "papers").select("rec_id", "canonical_id", "title"), "canonical_id").where("canonical_id is not null and trim(title) != ''")
    return p.groupBy("canonical_id").agg(F.min_by("title", "rec_id").alias("title"), F.min("rec_id").alias("rec_id"))


def _indexed(title: str, paper: str, section: str, body: str) -> Column:
    """What is indexed of a passage: its paper's title and id, its section and its text."""
    return F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (title, paper, section, body)))


def named_boost(paper: Column, query: Column) -> Column:
    """ID_BOOST where the query names the paper by its arXiv id."""
    return F.when(F.exists(named_ids(query), lambda i: paper.contains(i)), F.lit(ID_BOOST)).otherwise(0.0)


def _pooled(spark, d: str) -> DataFrame:
    """Each passage in the pool of its paper, whose title is the query."""
    return lookup(spread(_docs(spark, d), "doc_id"), _titles(spark, d), ["canonical_id"], F.col("doc_id"), "inner")


def _pool_scores(spark, d: str) -> DataFrame:
    rows = _pooled(spark, d).withColumn("length", F.length("text"))
    return pool_bm25(rows, "canonical_id", "doc_id", text.tokens(_indexed("title", "canonical_id", "section", "text")), text.tokens(F.col("title")), ["section", "length", "title", "rec_id"])


def _fused(spark, d: str) -> DataFrame:
    """Each paper's passages ranked for its title: dense (embedding rows stand in by id), BM25, section and id boosts."""
    emb = table(spark, d, "embeddings")
    n = emb.agg(F.count("*").alias("_n"))
    base = _pool_scores(spark, d).crossJoin(F.broadcast(n))  # one row
    boost = text.section_boost(F.coalesce("section", F.lit("")), text.intent(F.col("title"))) + named_boost(F.col("canonical_id"), F.col("title"))
    base = base.select("canonical_id", "doc_id", "section", "length", "bm25", boost.alias("boost"), (F.col("doc_id") % F.col("_n")).alias("_dv"), (F.col("rec_id") % F.col("_n")).alias("_qv"))
    dv = emb.select(F.col("vec_id").alias("_dv"), F.col("embedding").alias("_de"))
    qv = emb.select(F.col("vec_id").alias("_qv"), F.col("embedding").alias("_qe"))
    base = base.join(dv, "_dv", "left").join(qv, "_qv", "left")
    dense = F.round(F.coalesce(vectors.dot(F.col("_de"), F.col("_qe")), F.lit(0.0)), 9)
    scored = base.select("canonical_id", "doc_id", "section", "length", dense.alias("dense"), F.round(F.coalesce("bm25", F.lit(0.0)), 9).alias("bm25"), "boost")
    return fused(scored, ["canonical_id"], "doc_id")


def _asked(spark, d: str) -> DataFrame:
    """The stated query set: questions whose id is divisible by 50."""
    return table(spark, d, "d_oos_full_answers").where("qa_id % 50 = 0").select("qa_id", F.coalesce("question", F.lit("")).alias("question"))


def _q_entities(spark, d):
    return entities(_asked(spark, d), _titles(spark, d), "qa_id", "question", "canonical_id", "title").select("qa_id", "canonical_id", "place", F.round("score", 6).alias("score"))


def hybrid(asked: DataFrame, passages: DataFrame, resolved: DataFrame, k: int = 6, pool: int = POOL) -> DataFrame:
    """(qa_id, doc_id, dense_rank, bm25_rank, rrf, rank): the k best passages of each question.

    asked has (qa_id, question, embedding), passages (doc_id, canonical_id, title, section, text, embedding), resolved
    (qa_id, canonical_id). The `pool` passages nearest by vector are ranked again: reciprocal ranks by vector and BM25
    over the pool, plus boosts for papers named or resolved in the question and for sections that fit its intent.
    """
    near = top_similar(passages, asked.withColumnRenamed("qa_id", "doc_id"), pool, row_id="doc_id", distinct=False)
    p = cut(near.select(F.col("q").alias("qa_id"), "doc_id", F.col("score").alias("dense")).join(passages.drop("embedding"), "doc_id").join(asked.select("qa_id", "question"), "qa_id"))
    score = pool_bm25(p, "qa_id", "doc_id", text.tokens(_indexed("title", "canonical_id", "section", "text")), text.tokens(F.col("question")))
    boost = text.section_boost(F.coalesce("section", F.lit("")), text.intent(F.col("question"))) + named_boost(F.col("canonical_id"), F.col("question")) + F.when(F.col("_e").isNotNull(), F.lit(ENTITY_BOOST)).otherwise(0.0)
    hit = resolved.select("qa_id", "canonical_id").distinct().withColumn("_e", F.lit(1))
    scored = p.join(score, ["qa_id", "doc_id"], "left").join(hit, ["qa_id", "canonical_id"], "left")
    scored = scored.select("qa_id", "doc_id", "dense", F.round(F.coalesce("bm25", F.lit(0.0)), 9).alias("bm25"), boost.alias("boost"))
    return fused(scored, ["qa_id"], "doc_id").where(F.col("rank") <= k)


def _q_hybrid(spark, d):
    """Questions against the passages of all papers; embedding rows stand in by id."""
    emb = table(spark, d, "embeddings")
    n = F.broadcast(emb.agg(F.count("*").alias("_n")))  # one row
    vec = lambda df, i: df.crossJoin(n).withColumn("vec_id", F.col(i) % F.col("_n")).join(emb.select("vec_id", "embedding"), "vec_id").drop("vec_id", "_n")
    asked, docs = vec(_asked(spark, d), "qa_id"), vec(_pooled(spark, d).drop("rec_id"), "doc_id")
    got = hybrid(asked, docs, entities(_asked(spark, d), _titles(spark, d), "qa_id", "question", "canonical_id", "title"))
    return got.select("qa_id", "doc_id", "dense_rank", "bm25_rank", F.round("rrf", 6).alias("rrf"), "rank")


def _q_bm25(spark, d):
    return _pool_scores(spark, d).where("bm25 is not null").select("canonical_id", "doc_id", F.round("bm25", 6).alias("bm25"))


def _q_fused(spark, d):
    return _fused(spark, d).select("canonical_id", "doc_id", "dense", "bm25", "dense_rank", "bm25_rank", "rrf", "rank")


def _q_diverse(spark, d):
    df = _fused(spark, d).withColumn("section", F.coalesce("section", F.lit("")))
    return diverse(df, [], "canonical_id", "section").select("canonical_id", "doc_id", "section", "rank")


def _q_packed(spark, d):
    return packed(_fused(spark, d), ["canonical_id"], "length", 3000).groupBy("canonical_id").agg(F.count("*").alias("used"), F.sum("length").alias("chars"))


def _q_coverage(spark, d):
    return _fused(spark, d).where("rank = 1").select("canonical_id", "doc_id", text.coverage(F.col("dense")).alias("coverage"))


SEARCHES = ["loss landscapes entity linking", "novelty scores for citation recommendation", "weather nowcasting benchmark", "attention heads attention heads"]


def search(docs: DataFrame, queries: list[str], limit: int = 20, k1: float = 1.2) -> DataFrame:
    """(query, doc_id, bm25, rank): the best `limit` documents of each query over the whole collection.

    Texts are cut into tokens once; what is kept of a document are its length and the tokens that a query asks for.
    """
    spark = docs.sparkSession
    q = spark.range(1).select(F.explode(F.array(*map(F.lit, queries))).alias("query")).select("query", F.explode(text.tokens(F.col("query"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    terms = sorted({r["term"] for r in q.select("term").collect()})  # of the stated queries
    kept = docs.select("doc_id", text.tokens(F.col("text")).alias("_w"))
    kept = cut(kept.select("doc_id", F.size("_w").alias("length"), F.filter("_w", lambda x: x.isin(terms)).alias("hits")).where("length > 0"))
    stats = kept.agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"))
    hits = kept.where(F.size("hits") > 0).select("doc_id", "length", F.explode("hits").alias("term")).groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
    df = kept.select(F.explode(F.array_distinct("hits")).alias("term")).groupBy("term").agg(F.count("*").alias("_df"))
    known = F.broadcast(q.join(df, "term"))  # the queries' terms
    hits = hits.join(known, "term").crossJoin(F.broadcast(stats))  # one row
    idf = F.log1p((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - B + B * F.col("length") / F.col("_avg")))
    got = hits.groupBy("query", "doc_id").agg(F.round(F.sum(gain * F.col("qtf")), 9).alias("bm25"))
    w = Window.partitionBy("query").orderBy(F.desc("bm25"), "doc_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _q_search(spark, d):
    return search(spread(table(spark, d, "documents").select("doc_id", "text").where("trim(text) != ''"), "doc_id"), SEARCHES).select("query", "doc_id", "rank", F.round("bm25", 6).alias("bm25"))


def _q_intents(spark, d):
    """The intent of each question and of each document's text, and what a section named like its kind or section gains."""
    q = table(spark, d, "d_oos_full_answers").select(F.lit("question").alias("src"), F.col("qa_id").alias("id"), "question", F.col("kind").alias("section"))
    x = table(spark, d, "documents").select(F.lit("document").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("question"), "section")
    both = q.unionByName(x).withColumn("intent", text.intent(F.coalesce("question", F.lit(""))))
    return both.select("src", "id", "intent", F.round(text.section_boost(F.coalesce("section", F.lit("")), F.col("intent")), 6).alias("boost"))


def _q_tokens(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("tokens"), F.size(F.array_distinct(text.tokens(F.col("text")))).cast("long").alias("distinct_tokens"))


def named_ids(c: Column) -> Column:
    """The distinct arXiv ids that c names, without versions, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(NAMED), 1)))


def _q_ids(spark, d):
    """All ids of a query that names two papers: those of each citation, as they are spelled."""
    t = F.concat_ws(" ", F.lit("compare"), "citer_id", F.lit("and"), "cited_id")
    return table(spark, d, "edges").select("row_id", F.array_join(named_ids(t), ",").alias("ids"))


def _q_cache(spark, d):
    q = table(spark, d, "d_oos_full_answers").where("id is not null")
    emb = table(spark, d, "embeddings")
    n = emb.agg(F.count("*").alias("_n"))
    a = q.crossJoin(F.broadcast(n)).withColumn("_v", F.length(F.coalesce("question", F.lit(""))) % F.col("_n"))  # one row
    a = a.join(emb.select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vec")), "_v").select(F.col("qa_id").alias("id"), F.col("id").alias("scope"), "vec")
    return cache_hits(a, a, ["scope"])


def _q_admitted(spark, d):
    """Answers the cache takes in: covered well enough, cited or no refusal; of each kind the newest 250."""
    q = table(spark, d, "d_oos_full_answers")
    cited = F.size(text.cited_numbers(F.col("answer_full"))) > 0
    ok = F.coalesce(F.col("coverage").isin("high", "partial"), F.lit(False)) & (cited | ~text.refuses(F.col("answer_full")))
    w = Window.partitionBy("kind").orderBy(F.desc("qa_id"))
    return q.where(ok).withColumn("rn", F.row_number().over(w)).where("rn <= 250").select("qa_id", "kind")


def _q_snippets(spark, d):
    df = table(spark, d, "documents").where("text is not null")
    s = F.trim(F.translate(F.substring("text", 1, 280), "\n", " "))
    return df.select("doc_id", s.alias("snippet"))


def _q_slices(spark, d):
    """Answers cut into slices of three words, as a reader of a stream would get them."""
    q = table(spark, d, "d_oos_full_answers").where(F.col("answer_full").rlike(r"[^ \t\n]"))
    w = q.select("qa_id", F.posexplode(F.filter(F.split("answer_full", r"[ \t\n]+"), lambda x: x != "")).alias("pos", "word"))
    g = w.groupBy("qa_id", F.floor(F.col("pos") / 3).cast("long").alias("slice")).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("l"))
    return g.select("qa_id", "slice", F.array_join(F.transform("l", lambda x: x["word"]), " ").alias("words"))


_T = text.TOKENS_SQL.format(c="text")
_I = text.TOKENS_SQL.format(c="concat_ws(' ', coalesce(title, ''), canonical_id, coalesce(section, ''), text)")
_DOCS = f"d AS (SELECT * FROM (SELECT doc_id, text, section, {key_sql('canonical_id')} AS canonical_id FROM documents) WHERE canonical_id IS NOT NULL AND trim(text) <> '')"
_TITLES = f"t AS (SELECT canonical_id, arg_min(title, rec_id) AS title, min(rec_id) AS rec_id FROM (SELECT rec_id, title, {key_sql('canonical_id')} AS canonical_id FROM papers) WHERE canonical_id IS NOT NULL AND trim(title) <> '' GROUP BY 1)"
_BM25 = (
    f"{_DOCS}, {_TITLES}, po AS (SELECT canonical_id, doc_id, term, count(*) AS tf FROM (SELECT canonical_id, doc_id, unnest({_I}) AS term FROM d JOIN t USING (canonical_id)) GROUP BY ALL), sz AS (SELECT canonical_id, doc_id, sum(tf) AS length FROM po GROUP BY ALL),"
    f" st AS (SELECT canonical_id, count(*) AS n, avg(length) AS av FROM sz GROUP BY 1), df AS (SELECT canonical_id, term, count(*) AS df FROM po GROUP BY ALL), q AS (SELECT canonical_id, term, count(*) AS qtf FROM (SELECT canonical_id, unnest({text.TOKENS_SQL.format(c='title')}) AS term FROM t) GROUP BY ALL),"
    " bm AS (SELECT canonical_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / av))) AS bm25 FROM q JOIN df USING (canonical_id, term) JOIN st USING (canonical_id) JOIN po USING (canonical_id, term) JOIN sz USING (canonical_id, doc_id) GROUP BY ALL)"
)


def _cases(col: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {text.any_sql(col, keys)} THEN '{name}'" for name, keys in rules) + f" ELSE '{default}' END"


def _boost(sec: str, wanted: str) -> str:
    return "CASE " + " ".join(f"WHEN {wanted} = '{n}' AND {text.any_sql(sec, keys)} THEN {b}::DOUBLE" for n, b, keys in text.BOOSTS) + " ELSE 0.0::DOUBLE END"


def _named(paper: str, query: str) -> str:
    return f"CASE WHEN len(list_filter(regexp_extract_all({query}, '{NAMED}', 1), lambda i: contains({paper}, i))) > 0 THEN 0.05::DOUBLE ELSE 0 END"


_DOT = "round(coalesce(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 9)"
_FUSED = (
    f"WITH {_BM25}, s AS (SELECT d.canonical_id, d.doc_id, d.section, length(d.text) AS length, {_DOT} AS dense, round(coalesce(bm25, 0), 9) AS bm25, {_boost('lower(coalesce(d.section, chr(0)))', '(' + _cases('lower(t.title)', text.INTENTS, 'GENERAL') + ')')} + {_named('d.canonical_id', 't.title')} AS boost"
    " FROM d JOIN t USING (canonical_id) LEFT JOIN embeddings a ON a.vec_id = d.doc_id % (SELECT count(*) FROM embeddings) LEFT JOIN embeddings b ON b.vec_id = t.rec_id % (SELECT count(*) FROM embeddings) LEFT JOIN bm ON bm.canonical_id = d.canonical_id AND bm.doc_id = d.doc_id),"
    " r1 AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY dense DESC, doc_id) AS dense_rank FROM s), r2 AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY bm25 DESC, dense_rank) AS bm25_rank FROM r1),"
    " r3 AS (SELECT *, round(1.0::DOUBLE / (60 + dense_rank) + 1.0::DOUBLE / (60 + bm25_rank) + boost, 9) AS rrf FROM r2), f AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY rrf DESC, dense_rank) AS rank FROM r3) "
)
_SEARCH = (
    "WITH qs AS (SELECT unnest([" + ", ".join(f"'{q}'" for q in SEARCHES) + f"]) AS query), q AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({text.TOKENS_SQL.format(c='query')}) AS term FROM qs) GROUP BY ALL),"
    f" po AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_T}) AS term FROM documents WHERE trim(text) <> '') GROUP BY ALL), sz AS (SELECT doc_id, sum(tf) AS length FROM po GROUP BY 1), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1), st AS (SELECT count(*) AS n, avg(length) AS av FROM sz),"
    " g AS (SELECT query, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / av))), 9) AS bm25 FROM q JOIN df USING (term) JOIN po USING (term) JOIN sz USING (doc_id), st GROUP BY ALL)"
    " SELECT query, doc_id, rank, round(bm25, 6) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bm25 DESC, doc_id) AS rank FROM g) WHERE rank <= 20"
)
_PLAIN = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_STOPS = ", ".join(f"'{w}'" for w in ENTITY_STOP)
_ENTITIES = (
    f"WITH {_TITLES}, qs AS (SELECT qa_id, coalesce(question, '') AS question FROM d_oos_full_answers WHERE qa_id % 50 = 0), kw AS (SELECT qa_id, {_PLAIN.format(c='k')} AS k FROM (SELECT qa_id, unnest(list_filter(regexp_extract_all(question, '\\b[A-Za-z0-9_.\\-]+\\b'), lambda x: length(x) > 2 AND lower(x) NOT IN ({_STOPS}))[:4]) AS k FROM qs)),"
    f" ti AS (SELECT canonical_id, p, len(string_split(p, ' ')) AS l FROM (SELECT canonical_id, {_PLAIN.format(c='title')} AS p FROM t)), es AS (SELECT count(*) AS n, avg(l) AS av FROM ti), kd AS (SELECT DISTINCT k FROM kw WHERE k <> ''),"
    " eh AS (SELECT k, canonical_id, l, (length(' ' || replace(p, ' ', '  ') || ' ') - length(replace(' ' || replace(p, ' ', '  ') || ' ', ' ' || replace(k, ' ', '  ') || ' ', ''))) / (length(replace(k, ' ', '  ')) + 2)::DOUBLE AS tf FROM ti JOIN kd ON contains(' ' || p || ' ', ' ' || k || ' ')),"
    " ed AS (SELECT k, count(*) AS df FROM eh GROUP BY 1), eg AS (SELECT k, canonical_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / av)) AS g FROM eh JOIN ed USING (k), es),"
    " en AS (SELECT qa_id, canonical_id, score, row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, canonical_id) AS place FROM (SELECT qa_id, canonical_id, round(sum(g), 9) AS score FROM kw JOIN eg USING (k) GROUP BY 1, 2) QUALIFY place <= 4)"
)
_HYBRID = (
    f"{_ENTITIES}, {_DOCS}, em AS (SELECT vec_id, embedding::DOUBLE[] AS e, count(*) OVER () AS n FROM embeddings), dv AS (SELECT d.*, t.title, em.e FROM d JOIN t USING (canonical_id) JOIN em ON em.vec_id = d.doc_id % em.n), qv AS (SELECT qs.*, em.e FROM qs JOIN em ON em.vec_id = qs.qa_id % em.n),"
    " s AS (SELECT qa_id, question, doc_id, canonical_id, section, title, text, round(list_inner_product(qv.e, dv.e), 9) AS dense FROM qv, dv QUALIFY row_number() OVER (PARTITION BY qa_id ORDER BY dense DESC, doc_id) <= 40),"
    f" po AS (SELECT qa_id, doc_id, term, count(*) AS tf FROM (SELECT qa_id, doc_id, unnest({_I}) AS term FROM s) GROUP BY ALL), sz AS (SELECT qa_id, doc_id, sum(tf) AS length FROM po GROUP BY ALL), st AS (SELECT qa_id, count(*) AS n, avg(length) AS av FROM sz GROUP BY 1), df AS (SELECT qa_id, term, count(*) AS df FROM po GROUP BY ALL),"
    f" q AS (SELECT qa_id, term, count(*) AS qtf FROM (SELECT qa_id, unnest({text.TOKENS_SQL.format(c='question')}) AS term FROM qs) GROUP BY ALL), bm AS (SELECT qa_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / av))), 9) AS bm25 FROM q JOIN df USING (qa_id, term) JOIN st USING (qa_id) JOIN po USING (qa_id, term) JOIN sz USING (qa_id, doc_id) GROUP BY ALL),"
    f" b AS (SELECT s.qa_id, s.doc_id, dense, coalesce(bm25, 0) AS bm25, {_boost('lower(coalesce(section, chr(0)))', '(' + _cases('lower(question)', text.INTENTS, 'GENERAL') + ')')} + {_named('s.canonical_id', 'question')} + CASE WHEN place IS NULL THEN 0 ELSE 0.025::DOUBLE END AS boost FROM s LEFT JOIN bm ON bm.qa_id = s.qa_id AND bm.doc_id = s.doc_id LEFT JOIN en ON en.qa_id = s.qa_id AND en.canonical_id = s.canonical_id),"
    " r1 AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY dense DESC, doc_id) AS dense_rank FROM b), r2 AS (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY bm25 DESC, dense_rank) AS bm25_rank FROM r1), r3 AS (SELECT *, round(1.0::DOUBLE / (60 + dense_rank) + 1.0::DOUBLE / (60 + bm25_rank) + boost, 9) AS rrf FROM r2)"
    " SELECT qa_id, doc_id, dense_rank, bm25_rank, round(rrf, 6) AS rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY rrf DESC, dense_rank) AS rank FROM r3) WHERE rank <= 6"
)
_REFUSE = text.any_sql("lower(coalesce(answer_full, ''))", text.REFUSALS)
QUERIES = {
    "txt4_txt5_pool_bm25": _q_bm25,
    "txt8_win1_win2_fusion": _q_fused,
    "ded6_diverse_passages": _q_diverse,
    "win5_context_packing": _q_packed,
    "txt9_coverage": _q_coverage,
    "top1_search": _q_search,
    "txt2_entities": _q_entities,
    "txt8_hybrid_pools": _q_hybrid,
    "txt6_txt7_intents": _q_intents,
    "txt3_tokens": _q_tokens,
    "str6_query_ids": _q_ids,
    "txt11_cache_hits": _q_cache,
    "txt12_cache_admission": _q_admitted,
    "txt13_snippets": _q_snippets,
    "api2_word_slices": _q_slices,
}
SQL = {
    "txt4_txt5_pool_bm25": f"WITH {_BM25} SELECT canonical_id, doc_id, round(bm25, 6) AS bm25 FROM bm",
    "txt8_win1_win2_fusion": _FUSED + "SELECT canonical_id, doc_id, dense, bm25, dense_rank, bm25_rank, rrf, rank FROM f",
    "ded6_diverse_passages": _FUSED + "SELECT canonical_id, doc_id, section, rank FROM (SELECT canonical_id, doc_id, coalesce(section, '') AS section, rank FROM f QUALIFY row_number() OVER (PARTITION BY canonical_id, coalesce(section, '') ORDER BY rank) = 1) QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY rank) <= 3",
    "win5_context_packing": _FUSED + ", g AS (SELECT *, sum(length) OVER (PARTITION BY canonical_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT canonical_id, count(*) AS used, sum(length)::BIGINT AS chars FROM g WHERE run <= 3000 OR rank = 1 GROUP BY 1",
    "txt9_coverage": _FUSED + "SELECT canonical_id, doc_id, CASE WHEN dense < 0.55 THEN 'low' WHEN dense < 0.70 THEN 'partial' ELSE 'high' END AS coverage FROM f WHERE rank = 1",
    "top1_search": _SEARCH,
    "txt2_entities": _ENTITIES + " SELECT qa_id, canonical_id, place, round(score, 6) AS score FROM en",
    "txt8_hybrid_pools": _HYBRID,
    "txt6_txt7_intents": f"WITH b AS (SELECT 'question' AS src, qa_id AS id, question AS q, kind AS section FROM d_oos_full_answers UNION ALL SELECT 'document', doc_id, text, section FROM documents), i AS (SELECT src, id, section, {_cases('lower(coalesce(q, chr(0)))', text.INTENTS, 'GENERAL')} AS intent FROM b) SELECT src, id, intent, round({_boost("lower(coalesce(section, chr(0)))", 'intent')}, 6) AS boost FROM i",
    "txt3_tokens": f"SELECT doc_id, len({_T}) AS tokens, len(list_distinct({_T})) AS distinct_tokens FROM documents WHERE text IS NOT NULL",
    "str6_query_ids": f"SELECT row_id, array_to_string(list_sort(list_distinct(regexp_extract_all(concat_ws(' ', 'compare', citer_id, 'and', cited_id), '{NAMED}', 1))), ',') AS ids FROM edges",
    "txt11_cache_hits": "WITH a AS (SELECT qa_id, id, embedding::DOUBLE[] AS v FROM d_oos_full_answers JOIN embeddings ON vec_id = length(coalesce(question, '')) % (SELECT count(*) FROM embeddings) WHERE id IS NOT NULL), s AS (SELECT x.qa_id AS id, y.qa_id AS hit, round(list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))), 9) AS similarity FROM a x JOIN a y ON x.id = y.id AND y.qa_id < x.qa_id) SELECT * FROM s WHERE similarity >= 0.92 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, hit) = 1",
    "txt12_cache_admission": f"SELECT qa_id, kind FROM d_oos_full_answers WHERE coverage IN ('high', 'partial') AND (regexp_matches(coalesce(answer_full, ''), '\\[\\d+\\]') OR NOT {_REFUSE}) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY qa_id DESC) <= 250",
    "txt13_snippets": "SELECT doc_id, trim(translate(text[:280], chr(10), ' ')) AS snippet FROM documents WHERE text IS NOT NULL",
    "api2_word_slices": "WITH w AS (SELECT qa_id, list_filter(regexp_split_to_array(answer_full, '[ \\t\\n]+'), lambda x: x <> '') AS l FROM d_oos_full_answers WHERE regexp_matches(answer_full, '[^ \\t\\n]')), s AS (SELECT qa_id, l, unnest(range(0, (len(l) + 2) // 3)) AS slice FROM w) SELECT qa_id, slice, array_to_string(l[slice * 3 + 1 : slice * 3 + 3], ' ') AS words FROM s",
}
