"""Curated lists against a plain greedy choice over the whole group."""

import random

from pyspark.sql import functions as F

from citeweave.operators.library import curated


def greedy(rows, target, threshold, strong, enough):
    fits = [r for r in rows if (r[4] or 0) >= strong]
    rows = fits if len(fits) >= max(enough, target // 2) else rows
    rows = sorted(rows, key=lambda r: (-(r[3] or 0), r[1]))
    taken, skipped = [], []
    for r in rows:
        w = set((r[2] or "").split())
        near = any(w and set((t[2] or "").split()) and len(w & set((t[2] or "").split())) / max(len(w), len(set((t[2] or "").split()))) >= threshold for t in taken)
        (skipped if near or len(taken) >= target else taken).append(r)
    return [r[1] for r in (taken + skipped)[:target]]


def test_curated_equals_a_greedy_choice(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        g = ["hot", "hot", "cool", "few"][i % 4] if i < 200 else "same"
        title = None if i % 37 == 0 else "one and the same title" if g == "same" else " ".join(rng.choice("abcd") for _ in range(3))
        rows.append((g, i, title, rng.choice([None, 1, 2, 3]), rng.choice([None, 0.0, 0.5])))
    rows += [(None, 900, "no group", 3, 0.5), ("one", 901, "lone", None, None)]
    df = spark.createDataFrame(rows, "g string, rec_id long, title string, c int, rel double").withColumn("n", F.lit("an extra column"))
    for pool in (2, 200):
        got = {}
        for r in curated(df, "g", [F.col("c")], F.col("rel"), pool=pool, target=12, enough=15).orderBy("g", "place").collect():
            got.setdefault(r["g"], []).append(r["rec_id"])
        want = {g: greedy([r for r in rows if r[0] == g], 12, 0.88, 0.25, 15) for g in ("hot", "cool", "few", "same", "one")}
        assert got == want
    assert curated(df.limit(0), "g", [F.col("c")]).count() == 0
