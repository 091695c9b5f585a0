"""The data operators against brute force, exact round trips and made-up cases."""

import datetime as dt
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeweave.llm import mixing, neighbours, packing, pairs, queries, similar, stuffing, survivors
from citeweave.llm.tokens import VOCABULARY, encoding, token_counts
from citeweave.session import table

# ---- pairs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_suffix_automaton(q, a):
    text = "".join(q)
    want = [max(n for n in range(i + 2) if "".join(a[i + 1 - n : i + 1]) in text) for i in range(len(a))]
    assert pairs.SuffixAutomaton(q).matches(a) == want


@pytest.mark.parametrize(
    "q, a, r, want",
    [
        ("What is X?", None, False, "empty"), ("What is X?", " \n", True, "empty"), (None, "N/A", None, "empty"), ("q", "<p></p>", False, "empty"), ("q", "References: [1], [2]", False, "empty"), ("q", "​", False, "empty"),
        ("What are the limits of Foo?", "what are the limits of foo", False, "copy"), ("What are the limits of Foo?", "You asked: What are the limits of Foo?", True, "copy"),
        ("What are the limits of Foo?", "What are the limits of Foo? The model fails on long texts and needs labels.", False, None),
        ("How many took part in the Foo study?", "47 participants [2].", False, None), ("Can X be done?", "Yes, under label noise", False, None),
        ("What is X?", "I don't know.", False, "refusal"), ("What is X?", "I don't know.", True, None), ("What is X?", "I don't know.", None, None), ("Was ist X?", "Dazu kann ich leider nichts sagen.", False, "refusal"),
        ("What is X?", "The first release does not provide scores, whereas the second one covers them in detail.", False, None),
        ("What is X?", "X is a method for ranking papers. It combines several", False, "truncated"), ("What is X?", "X is a method. It has\n* **", False, "truncated"), ("What is X?", "X is a method for ranking papers (see [2", False, "truncated"),
        ("What is X?", "- X is a method for ranking.\n- It is used by many.\n\nRelated keywords:\n* deep nets\n* sparse maps", False, None),
        ("What is the cost of the method?", "Wir haben das Modell mit allen Daten auf einem Gerät trainiert, und die Kosten sind nicht hoch.", False, "language"),
        ("Welche Grenzen hat das Verfahren?", "Das Verfahren ist bei langen Texten nicht stabil.", False, None), ("", "A complete answer to nothing.", False, None),
    ],
)
def test_judge(q, a, r, want):
    assert pairs.judge(q, a, r) == want


def test_flag_pairs(spark):
    long = "This is a whole sentence of the answer. " * 20_000
    rows = [(1, "What is it?", long, False, 0), (2, "What is it?", None, None, 0), (2, "What is it?", None, None, 0), (None, None, "-", None, 0)]
    df = spark.createDataFrame(rows, "qa_id long, question string, answer_full string, should_refuse boolean, defect int")
    got = pairs.flag_pairs(df, "qa_id", "question", "answer_full", "should_refuse")
    assert got.columns == ["qa_id", "defect"] and sorted((r["qa_id"] or 0, r["defect"]) for r in got.collect()) == [(0, "empty"), (2, "empty"), (2, "empty")]
    assert pairs.flag_pairs(df.limit(0), "qa_id", "question", "answer_full", "should_refuse").count() == 0


# ---- survivors

PAPER = "rec_id long, canonical_id string, doi string, citation_count int, source string, updated_at double"


def test_survivors(spark):
    rows = [
        (1, "arxiv:2101.00001", "10.1000/a", 5, "s2", 100.0), (2, " arXiv:2101.00001v2", "DOI: 10.1000/A", 7, " ArXiv ", 50.0), (3, "doi:10.1000/A", None, -1, None, float("nan")),
        (4, "s2:x", "10.1000/b", None, "arxiv", 5e9), (5, "s2:y", "10.1000/b", 3, "???", 10.0), (6, "s2:z", "n/a", 1, "s2", 1.0), (7, None, None, 1, "s2", 1.0), (8, None, "", 1, "s2", 1.0), (9, "s2:X", None, 1, "s2", 1.0),
    ]
    papers = spark.createDataFrame(rows, PAPER).withColumn("field", F.lit("x")).withColumn("group_id", F.lit("y"))
    trust = spark.createDataFrame([("arxiv", 1), ("s2", 2), (None, 3)], "source string, trust_rank int")
    votes = survivors.field_votes(papers, trust, survivors.same_work(papers))
    got = {(r["group_id"], r["field"]): r["rec_id"] for r in survivors.winners(votes).collect()}
    assert got == {(1, "doi"): 2, (1, "source"): 2, (1, "citation_count"): 1, (1, "updated_at"): 1, (4, "doi"): 4, (4, "source"): 4, (4, "citation_count"): 5, (4, "updated_at"): 5}
    one = {r["group_id"]: r for r in survivors.merged(survivors.winners(votes)).collect()}
    assert one[1]["doi"] == "10.1000/a" and one[1]["citation_count"] == 5 and one[4]["updated_at"] == 10.0
    assert survivors.same_work(papers.limit(0)).count() == 0
    assert survivors.winners(survivors.field_votes(papers.limit(0), trust, survivors.same_work(papers))).count() == 0
    with pytest.raises(ValueError):
        survivors.winners(votes, "odd")


def test_summed_votes(spark):
    rows = [(1, "a", 10.0, 1, "x"), (1, "b", 10.0, 2, "y"), (1, "b", 10.0, 3, "y"), (1, "b", 10.0, 4, "y")]
    votes = spark.createDataFrame([(g, "source", v, r, 2 if v == "b" else 1, float(survivors.SNAPSHOT)) for g, v, _, r, _ in rows], "group_id long, field string, value string, rec_id long, rank int, seen double")
    assert survivors.winners(votes, "sum").first()["value"] == "b" and survivors.winners(votes).first()["value"] == "a"


# ---- similar records


def brute_pairs(rows, threshold=0.7, least=30):
    w = lambda t: re.findall(r"[^\W_]+", t.lower())
    bags = {i: Counter(w(f"{t} {a}")) for i, t, a in rows if t and t.strip() and a is not None and len(w(a)) >= least}
    out = set()
    for (i, x), (j, y) in itertools.combinations(sorted(bags.items()), 2):
        o = sum((x & y).values())
        if o / (sum(x.values()) + sum(y.values()) - o) >= threshold:
            out.add((i, j))
    return out


def edited(rng, n):
    vocab = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    while i < n:
        base = [rng.choice(vocab) for _ in range(rng.randint(28, 90))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            x = list(base)
            for _ in range(rng.choice([0, 0, 3, 8, 15, 25])):
                k = rng.randrange(len(x))
                x[k : k + rng.choice([0, 1, 2])] = [rng.choice(vocab)] * rng.choice([0, 1, 2])
            if rng.random() < 0.3:
                rng.shuffle(x)
            rows.append((i, "a title", " ".join(x)))
            i += 1
    return rows


def test_similar_pairs_loses_none(spark, monkeypatch):
    rows = edited(random.Random(7), 260) + [(9001, None, "x"), (9002, "", "x " * 40), (9003, "t", None), (9004, "t", "")] + [(9100 + i, "A title", "same words " * 20) for i in range(5)]
    df = spark.createDataFrame(rows, "rec_id long, title string, abstract string").withColumn("rep", F.lit(1)).withColumn("size", F.lit(2)).repartition(3)
    want = brute_pairs(rows)
    got = [(r["rec_a"], r["rec_b"]) for r in similar.similar_pairs(df, "rec_id", "title", "abstract").collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 60
    monkeypatch.setattr(similar, "BLOCK_MIN", 16)
    small = similar.similar_pairs(df, "rec_id", "title", "abstract")
    assert {(r["rec_a"], r["rec_b"]) for r in small.collect()} == want
    assert similar.similar_pairs(df.limit(0), "rec_id", "title", "abstract").count() == 0


def test_large_classes_are_stars(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "t", text) for i in range(100)] + [(500, "t", text + " more"), (501, "t", text + " more"), (502, "t", "z " * 40)]
    df = spark.createDataFrame(rows, "rec_id long, title string, abstract string")
    got = {(r["rec_a"], r["rec_b"]) for r in similar.similar_pairs(df, "rec_id", "title", "abstract", expand=10).collect()}
    assert got == {(0, i) for i in range(1, 100)} | {(0, 500), (0, 501), (500, 501)}
    huge = spark.createDataFrame([(1, "t", "a b c " * 60_000), (2, "t", "a b c " * 60_000 + "d")], "rec_id long, title string, abstract string")
    assert similar.similar_pairs(huge, "rec_id", "title", "abstract").count() == 1


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_bitmaps_bound_the_difference(seed):
    rng = np.random.default_rng(seed)
    a, b = (np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 300))) for _ in range(2))
    both = rng.choice(a, len(a) // 2, replace=False)
    b = np.union1d(b, both)
    bits = [np.bincount(x & (similar.BITS - 1), minlength=similar.BITS) & 1 for x in (a, b)]
    assert (bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_long_bags_are_folded(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([40, 90, 150, 400, 900]))]
        rows.append((2 * i, "t", " ".join(base)))
        cut = len(base) // rng.choice([5, 6, 12])
        rows.append((2 * i + 1, "t", " ".join(base[cut:] if i % 2 else base + [rng.choice(vocab) for _ in range(cut)])))
    df = spark.createDataFrame(rows, "rec_id long, title string, abstract string")
    want = brute_pairs(rows)
    assert {(r["rec_a"], r["rec_b"]) for r in similar.similar_pairs(df, "rec_id", "title", "abstract").collect()} == want and len(want) > 20


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_folded_bitmaps_bound_the_difference(seed):
    rng = np.random.default_rng(seed)
    a, b = (np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 600))) for _ in range(2))
    b = np.union1d(b, rng.choice(a, len(a) // 2, replace=False))
    x, y = (similar.Block(np.array([1]).tobytes(), np.array([len(e)]).tobytes(), similar.bitmap(e).tobytes()) for e in (a, b))
    for w in (2, 4, 8):
        if w <= min(x.n_words[0], y.n_words[0]):
            differ = np.bitwise_count(x.folded(slice(0, 1), w) ^ y.folded(slice(0, 1), w)).sum()
            assert differ <= len(np.setxor1d(a, b))


# ---- neighbours


def vectors(rng, n, dim, tight):
    centres = rng.standard_normal((max(1, n // 7), dim))
    x = centres[rng.integers(0, len(centres), n)] + tight * rng.standard_normal((n, dim))
    return x * rng.uniform(0.5, 3, (n, 1))


def brute_near(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    return {ids[i]: [ids[j] for j in np.lexsort((np.arange(len(ids)), -s[i]))[:k]] for i in range(len(ids))}


def test_nearest_recall(spark):
    rng = np.random.default_rng(1)
    x = np.float32(np.vstack([vectors(rng, 4200, 24, 0.3), rng.standard_normal((200, 24))])).astype(float)
    ids = [f"p{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, p, "m", 24, [float(z) for z in v], dt.datetime(2024, 1, 1)) for i, (p, v) in enumerate(zip(ids, x))], VECTOR)
    want, got = brute_near(ids, x, 5), defaultdict(list)
    for r in neighbours.nearest(df).orderBy("q", "rank").collect():
        got[r["q"]].append(r["n"])
    asked = ids[::50]
    hit = sum(len(set(want[i]) & set(got[i])) for i in ids) / (5 * len(ids))
    assert hit >= 0.97 and sum(len(set(want[i]) & set(got[i])) for i in asked) / (5 * len(asked)) >= 0.9
    assert all(len(v) == 5 for v in got.values()) and len(got) == len(ids)


VECTOR = "vec_id long, canonical_id string, model string, dim int, vector array<float>, embedded_at timestamp"


def test_nearest_small_cases(spark):
    d = dt.datetime(2024, 1, 1)
    rows = [(1, "a", "m", 2, [1.0, 0.0], d), (2, "b", "m", 2, [2.0, 0.0], d), (3, "c", "m", 2, [0.0, 1.0], d), (4, "a", "m", 2, [0.0, -1.0], dt.datetime(2023, 1, 1)), (5, "a", "m", 2, [0.0, 5.0], None), (6, "d", "m", 2, [0.0, 0.0], d), (7, "e", "m", 2, [1.0], d), (8, "f", "m", 2, [float("nan"), 1.0], d), (9, "g", "m", 2, None, d), (10, "h", "m", 2, [None, 1.0], d), (11, None, "m", 2, [1.0, 1.0], d), (12, "a", "other", 3, [1.0, 0.0, 0.0], d)]
    df = spark.createDataFrame(rows, VECTOR).withColumn("id", F.lit(1)).withColumn("tile", F.lit(2))
    got = {(r["q"], r["n"]): r["cos"] for r in neighbours.nearest(df).collect()}
    assert got == {("a", "b"): 1.0, ("b", "a"): 1.0, ("a", "c"): 0.0, ("c", "a"): 0.0, ("b", "c"): 0.0, ("c", "b"): 0.0}
    assert neighbours.nearest(df.limit(0)).count() == 0
    ties = spark.createDataFrame([(i, f"t{i}", "m", 2, [1.0, 0.0], d) for i in range(9)], VECTOR)
    near = [r["n"] for r in neighbours.nearest(ties).where("q = 't8'").orderBy("rank").collect()]
    assert near == ["t0", "t1", "t2", "t3", "t4"]


def test_error_bounds():
    rng = np.random.default_rng(3)
    x, q = (neighbours.unit(rng.standard_normal((n, 64))) for n in (500, 50))
    rot = neighbours.rotation(64)
    est, err = neighbours.estimate(q, *neighbours.encode(x, rot), rot)
    assert (np.abs(est - q @ x.T) <= err).mean() > 0.99 and np.abs(est - q @ x.T).mean() < 0.12


def test_hot_cell_is_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.default_rng(5)
    x = np.float32(rng.standard_normal((400, 16))).astype(float)
    ids = [f"p{i:04d}" for i in range(400)]
    df = spark.createDataFrame([(i, p, "m", 16, [float(z) for z in v], None) for i, (p, v) in enumerate(zip(ids, x))], VECTOR)
    got = defaultdict(list)
    for r in neighbours.nearest(df, k=3).orderBy("q", "rank").collect():
        got[r["q"]].append(r["n"])
    assert sum(got[i] == n for i, n in brute_near(ids, x, 3).items()) >= 396


# ---- packing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20), st.integers(40, 60))
def test_plan_bins(hist, capacity):
    rows, bins = packing.plan_bins(hist, capacity)
    load, seen = Counter(), Counter()
    for length, rank, items, start, per in rows:
        for k in range(items):
            load[start + k // per] += length
        assert rank == seen[length]
        seen[length] += items
    assert seen == Counter(hist) and set(load) == set(range(bins)) and all(v <= capacity for v in load.values())
    free, n = [], 0  # best fit over items opens as many bins
    for length in sorted((x for x, c in hist.items() for _ in range(c)), reverse=True):
        fit = [i for i, f in enumerate(free) if f >= length]
        i = min(fit, key=lambda i: free[i]) if fit else len(free)
        if not fit:
            free.append(capacity)
        free[i] -= length
    assert bins == len(free)


def test_pack(spark):
    rng = random.Random(2)
    sized = [(i, rng.choice([7, 7, 7, rng.randint(1, 60), 150])) for i in range(400)] + [(900, 0), (901, 0)]
    df = spark.createDataFrame(sized, "doc_id long, tokens long").withColumn("bin", F.lit(1)).withColumn("len", F.lit(2))
    boxes = spark.createDataFrame([("s", 50), ("l", 128), ("none", None), ("zero", 0)], "container string, capacity_tokens int")
    got = packing.pack(df, boxes).collect()
    for name, cap in (("s", 50), ("l", 128)):
        rows = [r for r in got if r["container"] == name]
        load, docs = Counter(), defaultdict(list)
        for r in rows:
            load[r["bin"]] += r["tokens"]
            docs[r["doc_id"]].append((r["first_token"], r["tokens"]))
        assert all(v <= cap for v in load.values()) and set(load) == set(range(len(load)))
        for i, t in sized:
            at = 0
            for first, n in sorted(docs[i]):
                assert first == at and (n == cap or at + n == t)
                at += n
            assert at == t and (len(docs[i]) == 1 if 0 < t <= cap else True)
        assert sum(load.values()) / (len(load) * cap) > 0.97
    assert packing.pack(df.limit(0), boxes).count() == 0 and packing.pack(df, boxes.limit(0)).count() == 0


def test_token_counts(spark):
    texts = ["Hello, world!", "", None, "Größe naïve 東京 <|endoftext|>", "a" * 30_000, "  \n\n x"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, tokens int")
    got = {r["id"]: r["tokens"] for r in token_counts(df, "text", ["id"]).collect()}
    enc = encoding(VOCABULARY)
    for i, t in enumerate(texts):
        assert got[i] == len(enc.encode_ordinary(t or "")) and enc.decode(enc.encode_ordinary(t or "")) == (t or "")


# ---- mixing


def test_split_quotas():
    rng = np.random.default_rng(0)
    counts = np.array([100, 37, 3, 0])
    out = mixing.split_quotas(counts, 7, rng)
    assert (out.sum(0) == counts).all() and out.sum(1).max() - out.sum(1).min() <= 1 and (out >= 0).all()


def test_mix(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["Big", "big ", " BIG", "small"] if i % 10 else ["rare"]), rng.randint(1, 40)) for i in range(3000)] + [(9000, None, 5), (9001, "big", 0), (9002, "other", 9)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long").withColumn("block", F.lit(1)).withColumn("copy", F.lit(1))
    want = [("m", "big", 0.5, 1), ("m", "Small", 0.3, 3), ("m", "rare", 0.2, 4), ("m", "absent", 0.5, 2), ("m", "bad", -1.0, 2), ("n", "rare", 1.0, 2), (None, "big", 1.0, 1)]
    t = spark.createDataFrame(want, "mix string, source string, target_weight double, max_repeats int")
    got = mixing.mix(df, t).collect()
    times, tokens = Counter(), Counter()
    for r in got:
        times[r["mix"], r["source"], r["doc_id"]] += 1
        tokens[r["mix"], r["source"]] += r["tokens"]
    assert len({(r["mix"], r["doc_id"], r["copy"]) for r in got}) == len(got)
    limit = {(m, s.lower()): n for m, s, _, n in want if m}
    assert all(n <= limit[m, s] for (m, s, _), n in times.items()) and {d for _, _, d in times} <= {d[0] for d in docs[:3000]}
    total = sum(n for (m, _), n in tokens.items() if m == "m")
    for s, w in (("big", 0.5), ("small", 0.3), ("rare", 0.2)):
        assert tokens["m", s] / total == pytest.approx(w, abs=0.01)
    rare = sum(n for _, s, n in docs if s == "rare")
    assert tokens["n", "rare"] == 2 * rare and {n for (m, s, _), n in times.items() if m == "n"} == {2}
    shards = Counter(r["shard"] for r in got if r["mix"] == "m")
    assert len(shards) == mixing.MIN_SHARDS
    again = {(r["mix"], r["doc_id"], r["copy"], r["shard"]) for r in mixing.mix(df.repartition(5), t).collect()}
    assert again == {(r["mix"], r["doc_id"], r["copy"], r["shard"]) for r in got}
    assert mixing.mix(df.limit(0), t).count() == 0 and mixing.mix(df, t.limit(0)).count() == 0


def test_mix_is_within_a_document(spark):
    rng = random.Random(9)
    docs = [(i, rng.choice("abc"), rng.choice([3, 50, 700])) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("m", "a", 0.7, 1), ("m", "b", 0.2, 1), ("m", "c", 0.1, 2)], "mix string, source string, target_weight double, max_repeats int")
    tokens = Counter()
    for r in mixing.mix(df, t).collect():
        tokens[r["source"]] += r["tokens"]
    have = Counter()
    for _, s, n in docs:
        have[s] += n
    total = min(have["a"] / 0.7, have["b"] / 0.2, 2 * have["c"] / 0.1)
    assert all(abs(tokens[s] - w * total) < 700 for s, w in (("a", 0.7), ("b", 0.2), ("c", 0.1)))


def test_common_length_is_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    df = spark.createDataFrame([(i, 50 if i % 3 else 7) for i in range(300)], "doc_id long, tokens long")
    got = packing.pack(df, spark.createDataFrame([("s", 50)], "container string, capacity_tokens int")).collect()
    load = Counter()
    for r in got:
        load[r["bin"]] += r["tokens"]
    assert len(got) == 300 and max(load.values()) <= 50 and len(load) == 200 + -(-100 // 7)


# ---- stuffing


def test_encoding_matches_segments(spark):
    texts = ["The model was trained on the data. See https://a.example/x and #Tag.\nbuy cheap cheap pills", "", None, "<p>One more sentence about the method of the paper.</p>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for r in stuffing.read(df, "doc_id", "text").collect():
        want = list(stuffing.segments(texts[r["doc_id"]] or ""))
        assert r["lens"] == [len(i) for i, _, _ in want] and r["chars"] == [n for _, n, _ in want] and r["ids"] == [x for i, _, _ in want for x in i]
    ids, lens = np.array([5, 6, 7]), np.array([2, 1])
    s, e, v = stuffing.START, stuffing.END, stuffing.V
    key = lambda a, b, c: (a * v + b) * v + c
    assert list(stuffing.trigrams(ids, lens)) == [key(s, s, 5), key(s, 5, 6), key(5, 6, e), key(s, s, 7), key(s, 7, e)]



def test_page_shares(spark):
    prose = ["The model was trained on the data for a week. We show that the results are good for most of the cases. In this section, we discuss how the method works.", "This paper studies how the papers of a field cite each other. The graph was built from the lists of references, and we find that it is sparse."]
    spam = ["buy cheap pills, best cheap pills, online cheap pills, cheap pills sale, cheap pills offer, pills cheap online, buy pills", "\n".join(f"https://a{i}.example/x/{i}" for i in range(20)), " ".join(f"#Tag{i}Word" for i in range(30)), "cheap pills CHEAP PILLS cheap pills best cheap pills cheap pills CHEAP PILLS cheap pills"]
    rows = [(i, prose[i % 2]) for i in range(60)] + [(100 + i, t) for i, t in enumerate(spam)] + [(200, None), (201, "  "), (202, prose[0] + "\nSee https://a.example/b"), (203, spam[0]), (204, prose[0] * 3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("share", F.lit("x"))
    got = {r["doc_id"]: r["share"] for r in stuffing.page_shares(df, "doc_id", "text").collect()}
    assert len(got) == len(rows) and all(got[100 + i] > 0.5 for i in range(len(spam))) and got[203] > 0.5
    assert all(got[i] <= 0.5 for i in range(60)) and got[200] == got[201] == 0 and got[202] < 0.5 and got[204] < 0.5
    assert stuffing.page_shares(df.limit(0), "doc_id", "text").count() == 0


def test_model_is_a_distribution():
    m = stuffing.Model({(stuffing.START * stuffing.V + stuffing.START) * stuffing.V + stuffing.LOWER: 3, (stuffing.START * stuffing.V + stuffing.LOWER) * stuffing.V + stuffing.END: 3})
    for ctx in ((stuffing.START, stuffing.START), (stuffing.START, stuffing.LOWER), (stuffing.URL, stuffing.HASH)):
        assert sum(2 ** -m.one((ctx[0] * stuffing.V + ctx[1]) * stuffing.V + c) for c in range(stuffing.V)) == pytest.approx(1)


# ---- queries


want_unique = {"p2_found", "p3_found", "p4_found", "p5_found", "p6_packing", "p7_mix", "p8_found"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_gives_the_same(spark, data, name):
    import duckdb

    from tests.test_oracle import plain

    c = duckdb.connect()
    for t in ("papers", "source_trust"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(([plain(r[x]) for x in cols] for r in df.collect()), key=repr)
    cur = c.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(([plain(r[names.index(x)]) for x in cols] for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows and (len(set(map(tuple, rows))) == len(rows) or name not in want_unique)
    want = {"p2_found": ["qa_id", "defect"], "p3_found": ["group_id", "field", "rec_id"], "p4_found": ["rec_a", "rec_b"], "p5_found": ["model", "id_a", "id_b"], "p8_found": ["doc_id"]}
    assert df.columns == want.get(name, df.columns)


def test_p4_matches_brute_force(spark, data):
    rows = [tuple(r) for r in table(spark, data, "papers").select("rec_id", "title", "abstract").collect()]
    assert {tuple(r) for r in queries.QUERIES["p4_found"](spark, data).collect()} == brute_pairs(rows)
