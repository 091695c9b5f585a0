"""Small cases: keys, orphans under each match rule, skewed lookups, components, merges, rules, geometry, pages."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeweave import session
from citeweave.functions import scores, skew, text, vectors
from citeweave.functions.ids import arxiv_id, doi_key, key_text, split_key
from citeweave.operators import catalog, dense, evaluation, geometry, graph, impact, orphans, passages, ranking, retrieval, telemetry
from citeweave.operators.components import connected_components
from citeweave.plans import pipelines
from citeweave.sources import records


def test_keys(spark):
    raw = ["1806.07572", " arXiv:1806.07572v3 ", "https://arxiv.org/abs/1806.07572v2", "http://arxiv.org/pdf/1806.07572.pdf", "S2:AbC", "s2:AbC", "DOI:10.1/AbC", "nan", "arxiv:", "", "  ", None, "openalex:W1", "s2:1806.07572", "arxiv:W1", "hep-th/9901001v2"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, k string")
    got = {r["i"]: r["t"] for r in split_key(df, "k").withColumn("t", key_text(F.col("scheme"), F.col("ident"))).collect()}
    assert [got[i] for i in range(4)] == ["arxiv:1806.07572"] * 4
    assert got[4] == got[5] == "s2:AbC" and got[6] == "doi:10.1/abc" and got[7] == ":nan" and got[8] == "arxiv:"
    assert got[9] is None and got[10] is None and got[11] is None
    assert got[13] == "s2:1806.07572" and got[14] == "arxiv:w1" and got[15] == "arxiv:hep-th/9901001"
    ids = [r[0] for r in df.select(arxiv_id(F.col("k"))).collect()]
    assert ids[:4] == ["1806.07572"] * 4 and ids[7] is None and ids[11] is None
    dois = spark.createDataFrame([("10.1234/a",), (" DOI:10.1234/A ",), ("10.1/a",), ("10.",), (None,), ("10.1234/a b",)], "d string").select(doi_key(F.col("d"))).collect()
    assert [r[0] for r in dois] == ["10.1234/a", "10.1234/a", None, None, None, None]


def brute(refs, parents, match):
    out = []
    for i, key in refs:
        nulls = [x is None for x in key]
        if all(nulls) or (match == "simple" and any(nulls)):
            continue
        if match == "full":
            hit = not any(nulls) and key in parents
        elif match == "partial":
            hit = any(all(a is None or a == b for a, b in zip(key, p)) for p in parents)
        else:
            hit = key in parents
        if not hit:
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("match", orphans.MATCHES)
def test_orphans_by_match(spark, match):
    rng = random.Random(3)
    pick = lambda: rng.choice([None, "a", "b", "c"])
    refs = [(i, (pick(), pick(), pick())) for i in range(300)]
    parents = [(pick(), pick(), pick()) for _ in range(9)]
    r = spark.createDataFrame([(i, *k) for i, k in refs], "row_id long, x string, y string, z string")
    p = spark.createDataFrame(parents + parents, "x string, y string, z string")
    got = orphans.find_orphans(r, p, ["x", "y", "z"], "row_id", match)
    assert sorted(x["row_id"] for x in got.collect()) == brute(refs, parents, match)
    assert got.columns == ["row_id", "x", "y", "z", "reason"]
    empty = p.limit(0)
    assert orphans.find_orphans(r, empty, ["x", "y", "z"], "row_id", match).count() == len(brute(refs, [], match))
    assert orphans.find_orphans(r.limit(0), p, ["x", "y", "z"], "row_id", match).count() == 0


def test_orphan_reasons(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    refs = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(1)), (3, "b", t(5)), (4, "c", t(5)), (5, "a", None), (6, None, t(5)), (7, "d", t(1)), (7, "d", t(1))], "row_id long, k string, at timestamp")
    parents = spark.createDataFrame([("a", t(3), None), ("a", t(4), t(4)), ("b", t(1), t(2)), ("d", t(9), t(10))], "k string, born timestamp, dead timestamp")
    got = orphans.find_orphans(refs, parents, ["k"], "row_id", "exact", "at", "born", "dead").select("row_id", "reason").collect()
    assert sorted(tuple(r) for r in got) == [(2, "late"), (3, "deleted"), (4, "missing"), (7, "deleted"), (7, "deleted")]
    with pytest.raises(ValueError):
        orphans.find_orphans(refs, parents, ["k"], "row_id", "odd")
    with pytest.raises(ValueError):
        orphans.find_orphans(refs.withColumn("reason", F.lit(1)), parents, ["k"], "row_id")


def test_lookup_salts_hot_keys(spark):
    many = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    one = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([("hot", -1)], "k string, v long"))
    assert skew.hot_keys(many, ["k"], F.col("id"))[0] == ("hot",)
    a, b = skew.lookup(many, one, ["k"], F.col("id")), many.join(one, ["k"], "left")
    assert sorted(a.columns) == sorted(b.columns)
    assert a.select(*b.columns).exceptAll(b).count() == 0 and a.count() == 30_000


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == want and got.count() == len(want)


def test_components_chain_and_hub(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    hub = spark.range(1000, 3000).select(F.lit(999).cast("long").alias("a"), F.col("id").alias("b"))
    got = connected_components(chain.unionByName(hub).unionByName(spark.createDataFrame([(None, 5), (7, 7)], "a long, b long")))
    assert {r["component"]: r["n"] for r in got.groupBy("component").agg(F.count("*").alias("n")).collect()} == {0: 201, 999: 2001}


def test_merges(spark):
    old = spark.createDataFrame([("a", "T", 2000, 5), ("b", "U", None, 7)], "id string, title string, year int, n int")
    new = spark.createDataFrame([("a", "", 2001, None), ("c", "W", 1, 2)], "id string, title string, year int, n int")
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "title", "year", "n").collect())
    assert rows(catalog.merged(old, new, "id", ["title"], ["year", "n"])) == [("a", "", 2001, 5), ("b", "U", None, 7), ("c", "W", 1, 2)]
    assert rows(catalog.merged(old, new, "id", [], ["title", "year", "n"], True)) == [("a", "T", 2001, 5), ("b", "U", None, 7), ("c", "W", 1, 2)]
    assert rows(catalog.filled(old, new, "id", ["title", "year", "n"]))[0] == ("a", "T", 2000, 5)
    assert rows(catalog.merged(old.limit(0), new, "id", ["title"], ["year", "n"])) == [("a", "", 2001, None), ("c", "W", 1, 2)]


def test_rules(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    assert val(text.intent(F.lit("What are the limitations of X?"))) == "LIMITATIONS_FUTURE"
    assert val(text.intent(F.lit("which benchmark"))) == "EMPIRICAL_EVAL" and val(text.intent(F.lit("hello"))) == "GENERAL"
    assert val(text.section_boost(F.lit("Limitations"), F.lit("LIMITATIONS_FUTURE"))) == 0.020
    assert val(text.section_boost(F.lit(None).cast("string"), F.lit("GENERAL"))) == 0.0
    assert val(text.citations_valid(F.lit("a [1] b [4]"), F.lit(2))) is False and val(text.citations_valid(F.lit("a [1]"), F.lit(2))) is True
    assert val(text.citations_valid(F.lit("This is NOT covered."), F.lit(3))) is True and val(text.citations_valid(F.lit("yes"), F.lit(3))) is False
    assert val(scores.velocity(F.lit(5), F.lit(None), 2026)) == 0.3 and val(scores.recency(F.lit("2022-01"), 2026)) == 0.5
    assert val(scores.geometry_class(F.lit(0.4), F.lit(0.08), F.lit(0.6))) == "High Synergy Cone Blend"
    assert val(scores.geometry_class(F.lit(0.8), F.lit(0.01), F.lit(0.65))) == "Linear / Incremental Extension"
    assert val(scores.geometry_class(F.lit(0.2), F.lit(0.01), F.lit(0.3))) == "Paradigm Shift / Subspace Outlier"
    assert val(text.coverage(F.lit(0.6))) == "partial" and val(text.coverage(F.lit(None).cast("double"))) == "none"
    counts = lambda *xs: F.array(*(F.struct(F.lit(y).alias("year"), F.lit(n).cast("long").alias("n")) for y, n in xs))
    label = lambda t, *xs: val(scores.trajectory(counts(*xs), F.lit(t)))
    assert label(9, (2020, 0), (2021, 9)) == "exploding" and label(3, (2021, 3)) == "new_or_sparse" and label(30, (2019, 20), (2020, 8), (2021, 2)) == "declining"
    with pytest.raises(ValueError):
        scores.Weights({"embedding": 1.0})
    with pytest.raises(ValueError):
        scores.Weights({"embedding": 0.0, "recency": 0.0, "citation": 0.0, "author": 0.0})
    assert sum(scores.Weights(dict(scores.WEIGHTS)).without("author").values.values()) == pytest.approx(1)
    assert scores.normalised({"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75} and catalog.overfetch(5, True) == 40 and catalog.overfetch(5, False) == 5


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([float("nan"), 2.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = [r[0] for r in df.select(vectors.unit(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 1.0] and got[2] == [0.0, 0.0] and got[3] is None
    assert [r[0] for r in df.select(vectors.finite(F.col("v"))).collect()] == [True, False, True, False]


def test_cone_identities():
    e = np.eye(64)
    p = geometry.profile(e[0], e[:4])
    assert p["m"] == 1 and p["r2"] == pytest.approx(1) and p["delta"] == pytest.approx(0)
    p = geometry.profile((e[0] + e[1]) / np.sqrt(2), e[:2])
    assert p["delta"] == pytest.approx(0.5) and p["lam"] / p["lam"].sum() == pytest.approx([0.5, 0.5])
    assert geometry.profile(e[10], e[:5])["r2"] == 0 and geometry.profile(-e[0], e[:1])["delta"] == 0
    x = np.array([0.8, 0.4, np.sqrt(0.2), 0])
    p = geometry.profile(x, np.eye(4)[:2])
    assert p["r2"] == pytest.approx(0.8) and p["delta"] == pytest.approx(0.16) and p["residual"] == pytest.approx(np.sqrt(0.2))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 30))
def test_nnls_optimality(seed, n):
    rng = np.random.default_rng(seed)
    y = rng.standard_normal((n, 12))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    x = rng.standard_normal(12)
    x /= np.linalg.norm(x)
    lam = geometry.nnls(y @ y.T, y @ x)
    slope = y @ (y.T @ lam - x)
    assert (lam >= 0).all() and (slope >= -1e-7).all() and abs(lam @ slope) < 1e-7
    order = rng.permutation(n)
    assert geometry.profile(x, y[order])["r2"] == pytest.approx(geometry.profile(x, y)["r2"], abs=1e-8)


def test_fusion_and_packing(spark):
    rows = [("q", i, p, s, 100, d, b, 0.0) for i, (p, s, d, b) in enumerate([("A", "x", 0.9, 1.0), ("A", "x", 0.8, 5.0), ("A", "y", 0.7, 4.0), ("A", "z", 0.6, 3.0), ("A", "w", 0.5, 2.0), ("B", "x", 0.4, 6.0)])]
    df = spark.createDataFrame(rows, "q string, doc long, paper string, section string, length long, dense double, bm25 double, boost double")
    f = retrieval.fused(df, ["q"], "doc")
    kept = retrieval.diverse(f, ["q"], "paper", "section")
    n = {r["paper"]: r["n"] for r in kept.groupBy("paper").agg(F.count("*").alias("n")).collect()}
    assert n == {"A": 3, "B": 1}
    ctx = pipelines.answer_context(df, ["q"], "doc", "paper", budget=250).first()
    assert ctx["used"] == 2 and len(ctx["refs"]) == 2
    assert retrieval.packed(f.withColumn("length", F.lit(10_000)), ["q"], "length", 100).count() == 1
    assert retrieval.fused(df.limit(0), ["q"], "doc").count() == 0


def test_recommend(spark):
    rows = [(1, i, f"title number {i} about graphs", 1 - i / 10, 2000 + i, i * 10, 2) for i in range(8)]
    df = spark.createDataFrame(rows, "query_id long, paper_id long, title string, similarity double, year int, citation_count int, most int")
    df = df.withColumn("arxiv_id", F.lit(None).cast("string"))
    assert pipelines.recommend(df, 2010, 3).count() == 3
    assert [r["paper_id"] for r in pipelines.recommend(df, 2010, 3, since=2005).orderBy("rank").collect()][0] >= 5
    plain = [r["paper_id"] for r in pipelines.recommend(df, 2010, 3).orderBy("rank").collect()]
    assert len({r["paper_id"] for r in pipelines.recommend(df, 2010, 3, temperature=0.3).collect()}) == 3
    assert [r["paper_id"] for r in ranking.rerank(pipelines.recommend(df, 2010, 8), 3, 0.0).orderBy("rank").collect()] == plain


def test_evaluation_small(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "b", "a"]), ([], ["x"]), (["z"], ["x"])], "e array<string>, r array<string>")
    m = [tuple(r) for r in df.select(*(c.alias(k) for k, c in evaluation.metrics(F.col("e"), F.col("r"), 3).items())).collect()]
    assert m == [(1.0, 0.5, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    s = spark.createDataFrame([("g", 1.0, 10.0), ("g", 2.0, 20.0), ("g", 3.0, 30.0), ("h", 1.0, 1.0)], "g string, a double, b double")
    got = {r["g"]: r["rho"] for r in evaluation.spearman(s, ["g"], "a", "b").collect()}
    assert got == {"g": 1.0, "h": None}
    v = spark.range(500).select("id", (F.col("id") % 10).cast("double").alias("v"))
    b = evaluation.bootstrap_mean(v, [], "id", "v").first()
    assert b["lo"] < 4.5 < b["hi"] and b["hi"] - b["lo"] < 1.2 and b["mean"] == 4.5
    p = spark.createDataFrame([(1, 9)], "b long, c long").select(evaluation.mcnemar(F.col("b"), F.col("c"))).first()[0]
    assert p == pytest.approx(22 / 1024)


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 2, 3, 3]] + [(None,)], "v double")
    n = F.col("n")
    got = telemetry.percentile_at(df, "v", {"p50": F.floor(n * 0.5), "p0": F.lit(0) * n, "p99": F.floor(n * 0.99)}).first()
    assert (got["p50"], got["p0"], got["p99"]) == (3.0, 1.0, 5.0)


def test_passages(spark):
    body = "# A title of the paper\n\n" + " ".join(f"Sentence number {i} is here." for i in range(200)) + "\n## References\n" + "x" * 5000
    df = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "short")], "doc long, t string")
    got = passages.passages(df, "doc", "t").orderBy("ordinal").collect()
    assert {r["doc"] for r in got} == {1, 4} and all(r["end"] - r["start"] <= 1000 for r in got)
    assert sum(len(r["text"]) for r in got if r["section"] == "References") <= 1500 + 180 * 2
    got = [r for r in got if r["doc"] == 1]
    assert all(r["text"].endswith(".") for r in got if r["section"] == "A title of the paper")
    assert len({r["passage_id"] for r in got}) == len(got)
    assert df.where("doc = 1").select(passages.title_of(F.col("t"))).first()[0] == "A title of the paper"


def test_windows_contract():
    assert passages.windows("short section") == [(0, 13)] and passages.windows("") == [] and passages.windows("  \n ") == []
    body = "a" * 500 + ". " + "b" * 700
    assert passages.windows(body, 1000, 180) == [(0, 502), (322, 1202)]  # a break that begins exactly in the middle is taken
    assert passages.windows("a" * 498 + ". " + "b" * 700, 1000, 180) == [(0, 1000), (820, 1200)]
    assert passages.windows("x" * 600 + " " + "y" * 300 + "\n\n" + "z" * 300, 1000, 100)[0] == (0, 903)  # paragraphs before blanks
    for seed in range(40):
        rng = random.Random(seed)
        body = "".join(rng.choice(["word", " ", ". ", "; ", "\n", "\n\n", "x" * 30]) for _ in range(rng.randint(1, 400)))
        got, last = passages.windows(body, 200, 40, 1), 0
        for a, z in got:
            assert a <= last and z - a <= 200 and a < z
            last = z
        assert not got or body[last:].strip() == ""


def test_tail_sections_are_cut(spark):
    md = "# T\n\n" + "\n".join(f"## {h}\n" + "w " * 2000 for h in ("7 References", "Acknowledgments", "Annotated Bibliography", "Results"))
    got = passages.passages(spark.createDataFrame([(1, md)], "doc long, t string"), "doc", "t")
    most = {r["section"]: r["m"] for r in got.groupBy("section").agg(F.max("end").alias("m")).collect()}
    assert most["7 References"] <= 1500 and most["Acknowledgments"] <= 1500 and most["Annotated Bibliography"] <= 1500 and most["Results"] > 3000


def test_top_similar_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 6)).round(1)
    labels = [rng.choice(["a", "b"]) if i % 11 else None for i in range(300)]
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], str(labels[i]) if labels[i] else None, [0] if i % 2 else [0, 1]) for i in range(300)] + [(900, None, "a", [0, 1]), (901, [1.0], "a", [0, 1])], "vec_id long, embedding array<double>, label string, member array<int>").withColumn("rank", F.lit("x")).repartition(5)
    asked = rows.where("vec_id % 7 = 0 and vec_id < 300")

    def brute(ok, least=None):
        out = set()
        for q in range(0, 300, 7):
            s = [(-max(round(float(x[q] @ x[i]), 9), -1e9 if least is None else least), i) for i in range(300) if i != q and ok(q, i)]
            out |= {(q, i, r) for r, (_, i) in enumerate(sorted(s)[:4], 1)}
        return out

    for limit in (64_000_000, 6 * 8 * 10):
        monkeypatch.setattr(dense, "QUERY_BYTES", limit)
        monkeypatch.setattr(dense, "ROW_BLOCK", 100)
        got = lambda df: {(r["q"], r["vec_id"], r["rank"]) for r in df.collect()}
        assert got(dense.top_similar(rows, asked, 4)) == brute(lambda q, i: True)
        assert got(dense.top_similar(rows, asked, 4, same="label", least=0.0)) == brute(lambda q, i: labels[q] is not None and labels[q] == labels[i], 0.0)
        both = dense.top_similar(rows, asked, 4, dims=(0, 0), member="member")
        assert got(both.where("variant = 1")) == brute(lambda q, i: i % 2 == 0)
    assert dense.top_similar(rows, asked.limit(0), 4).count() == 0 and dense.top_similar(rows.limit(0), asked, 4).count() == 0


def test_running_and_row_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    want, seen = {}, {}
    for g, v, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + v
    assert {r["i"]: r["s"] for r in skew.running(df, ["g"], [F.col("v"), F.col("i")], F.col("v"), "s").collect()} == want
    plain = {r["i"]: r["n"] for r in skew.row_numbers(df.where("g is not null"), ["g"], [F.desc("v"), F.col("i")], "n", []).collect()}
    assert {r["i"]: r["n"] for r in skew.row_numbers(df.where("g is not null"), ["g"], [F.desc("v"), F.col("i")], "n", [("a",)]).collect()} == plain
    assert skew.running(df.limit(0), ["g"], [F.col("v"), F.col("i")], F.col("v"), "s").count() == 0


def test_groundedness(spark):
    a = spark.createDataFrame([(1, "The model uses graph attention layers [1]. It was trained on nothing known [2]. And this one has no tag."), (2, None), (3, "I cannot answer that question at all."), (4, "It cites a missing source here [9].")], "qa_id long, answer string")
    src = spark.createDataFrame([(1, 1, "graph attention layers in a model"), (1, 2, "cooking recipes")], "qa_id long, number int, text string")
    got = {r["qa_id"]: tuple(r)[1:] for r in evaluation.grounded(a, src, "qa_id", "answer", "number", "text").collect()}
    assert got[1] == (3, 2, 1, 0.5, 0.5) and got[2] == (0, 0, 0, 0.0, 0.0) and got[3][3:] == (1.0, 1.0) and got[4] == (1, 1, 0, 0.0, 0.0)


def test_bootstrap_does_not_depend_on_layout(spark):
    v = spark.range(300).select("id", ((F.col("id") % 7) - 2).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"))
    one, two = (sorted(map(tuple, evaluation.bootstrap_mean(v.repartition(n), ["g"], "id", "v").collect())) for n in (1, 7))
    assert one == two and all(0 <= r[-1] <= 0.1 for r in one)
    assert evaluation.bootstrap_mean(v.limit(0), ["g"], "id", "v").count() == 0


def test_centring(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 5)) + 3
    df = spark.createDataFrame([(f"p{i}", [float(z) for z in v]) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "id string, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = u - u.mean(0)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = {r["id"]: r["vec"] for r in geometry.centred(df).collect()}
    assert all(np.allclose(got[f"p{i}"], want[i]) for i in range(30))
    assert geometry.centred(df.limit(5)).count() == 5 and geometry.centred(df.limit(0)).count() == 0


def test_upserted_vectors(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    schema = "k string, v array<double>, at timestamp"
    old = spark.createDataFrame([("a", [1.0, 0.0], t(1)), ("b", [1.0, 0.0], t(5)), ("c", [1.0], t(1)), ("d", None, t(1))], schema)
    new = spark.createDataFrame([("a", [2.0, 0.0], t(1)), ("b", [2.0, 0.0], t(2)), ("e", [1.0, 1.0, 1.0], t(9)), ("f", [3.0, 0.0], None)], schema)
    assert {r["k"]: r["v"][0] for r in records.upserted(old, new, ["k"], "v", "at").collect()} == {"a": 2.0, "b": 1.0, "f": 3.0}
    assert records.upserted(old.limit(0), new, ["k"], "v", "at").count() == 0


def test_no_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.checkpoint_folder(Session())


PAGE = """<html><nav>menu</nav><h1>A Paper</h1><section id="S1"><h2>Intro</h2><p>{w} <math alttext="x^2"></math></p></section>
<section id="S2"><h2>Method</h2><h6>Theorem 1.</h6><p>{w} <math display="block" alttext="y"></math></p></section><footer>end</footer>
<li class="ltx_bibitem"><a href="https://arxiv.org/abs/2101.00001">J. Doe. A long title, 2021.</a></li><li class="ltx_bibitem">R. Roe &amp; co. Another title 1999 <a href="https://doi.org/10.1000/XY">x</a></li><li class="ltx_bibitem">tiny</li></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE.format(w="word " * 30)), (2, "<p>nothing</p>"), (3, None)], "id long, html string")
    got = {r["section_id"]: r for r in records.page_sections(df, "id", "html").collect()}
    assert set(got) == {"S1", "S2"} or set(got) == {"S1", "S2", "front_matter"}
    assert got["S1"]["title"] == "A Paper" and "$x^2$" in got["S1"]["text"] and "menu" not in got["S1"]["text"]
    assert "$$y$$" in got["S2"]["text"] and "**Theorem 1.**" in got["S2"]["text"] and got["S2"]["heading"] == "Method"
    bib = [tuple(r) for r in records.bibliography(df.where("html is not null"), "id", "html").orderBy("position").select("canonical_id", "year").collect()]
    assert bib == [("arxiv:2101.00001", 2021), ("doi:10.1000/xy", 1999)]


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"arxiv_id": "1806.07572v2", "title": " T ", "categories": ["a", " "], "published_date": "2018-06-20", "citation_count": "12"}, {"title": "no id"}]')
    got = records.corpus_rows(records.read_corpus(spark, str(tmp_path / "c.json"))).collect()
    assert len(got) == 1 and got[0]["arxiv_id"] == "1806.07572" and got[0]["year"] == 2018 and got[0]["citation_count"] == 12 and got[0]["categories"] == ["a"]
    (tmp_path / "f.xml").write_text('<feed><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>A\n  b</title><summary>s</summary><published>2021-01-01T00:00:00Z</published><author><name>X</name></author><category term="cs.LG"/><category term="stat.ML"/><primary_category term="stat.ML"/></entry></feed>')
    feed = records.read_feed(spark, str(tmp_path / "f.xml")).first()
    assert feed["title"] == "A b" and feed["categories"] == ["stat.ML", "cs.LG"] and feed["arxiv_id"] == "2101.00001"
    (tmp_path / "l.csv").write_text("Paper_ID,Title,Score\np1,T,5\np2,U,3\n")
    assert {r["paper_id"]: r["score"] for r in records.read_labels(spark, str(tmp_path / "l.csv")).collect()} == {"p1": 5.0, "p2": 3.0}
    (tmp_path / "bad.csv").write_text("paper_id,title,score\np1,T,9\n")
    with pytest.raises(Exception):
        records.read_labels(spark, str(tmp_path / "bad.csv")).collect()
    works = spark.createDataFrame([("https://openalex.org/W1", "https://doi.org/10.1/AB", "T", 2020, 5, {"world": [1], "hello": [0, 3]}, [{"display_name": "c"}], None)], records.WORK)
    w = records.work_rows(works).first()
    assert (w["canonical_id"], w["doi"], w["abstract"], w["categories"]) == ("openalex:W1", "10.1/ab", "hello world hello", ["c"])
    node = records.node_rows(spark.createDataFrame([("p", "T", None, 2020, 1, {"ArXiv": "2101.00001v3", "DOI": None}, [{"name": "n"}])], records.NODE)).first()
    assert node["canonical_id"] == "arxiv:2101.00001" and node["has_abstract"] is False


def test_similar_titles_finds_all(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        base = rng.sample(vocab, 13)
        rows.append((2 * i, " ".join(base)))
        rows.append((2 * i + 1, " ".join(base[:12] + [rng.choice(vocab)])))
    df = spark.createDataFrame(rows, "rec_id long, title string")
    sets = {}
    for i, t in rows:
        k = tuple(sorted(set(t.split())))
        sets[k] = min(i, sets.get(k, i))
    want = {(min(a, b), max(a, b)) for (x, a), (y, b) in itertools.combinations(sets.items(), 2) if len(set(x) & set(y)) / max(len(x), len(y)) >= 0.92}
    assert {(r["a"], r["b"]) for r in impact.similar_titles(df).collect()} == want and want


def test_empty_tables(spark, data):
    from citeweave.session import table

    e, p = table(spark, data, "edges").limit(0), table(spark, data, "papers").limit(0)
    assert graph.ranked_citations(e, p).count() == 0 and graph.example_citers(e).count() == 0
    assert catalog.without_duplicates(p).count() == 0 and orphans.citation_orphans(e, table(spark, data, "ref_edges").limit(0), p).count() == 0
    assert passages.passages(table(spark, data, "documents").limit(0), "doc_id", "text").count() == 0
