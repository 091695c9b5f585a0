"""The whole job where an earlier version did part of it: each case fails on that version."""

import random

import numpy as np
from pyspark.sql import functions as F

from citeweave.operators import geometry


def test_null_gives_every_paper_its_donors(spark):
    rng = random.Random(2)
    unit = lambda: (lambda v: [float(x) for x in v / np.linalg.norm(v)])(np.array([rng.gauss(0, 1) for _ in range(8)]))
    vec = {f"r{i}": unit() for i in range(60)}
    refs = {f"p{i:02}": set(rng.sample(sorted(vec), rng.choice([1, 3, 3, 4, 5, 9]))) for i in range(70)}
    refs["big"] = set(rng.sample(sorted(vec), 40))
    x = {p: unit() for p in refs}
    pairs = spark.createDataFrame([(p, r, x[p], vec[r]) for p, rs in refs.items() for r in sorted(rs)], "focal string, ref string, x array<double>, y array<double>")
    years = spark.createDataFrame([(p, 2000 + int(p[1:]) % 4) for p in refs if p not in ("big", "p01")], "focal string, year int")
    got = {r["focal"]: r for r in geometry.null_percentiles(pairs, years).collect()}
    assert set(got) == set(refs)
    for p, rs in refs.items():
        pool = sum(len(other - rs) >= len(rs) for q, other in refs.items() if q != p)
        want = ("too_few", 0) if len(rs) < 3 else ("ok", min(30, pool)) if pool >= 10 else ("null_pool_too_small", 0)
        assert (got[p]["status"], got[p]["n_null"]) == want
        assert (got[p]["pct_r2"] is not None) == (want[0] == "ok")
    assert {want["status"] for want in got.values()} == {"ok", "too_few", "null_pool_too_small"}
    size = pairs.groupBy("focal").agg(F.count("*").alias("n"), F.collect_list(F.xxhash64("ref")).alias("ids")).join(years, "focal", "left").fillna(0, ["year"])
    year = {r["focal"]: r["year"] for r in years.collect()}
    for r in geometry.null_donors(size, draws=4).collect():
        fit = sorted(abs(year.get(q, 0) - r["year"]) for q, other in refs.items() if q != r["focal"] and len(other - refs[r["focal"]]) >= r["level"])
        assert sorted(set(r["donors"])) == sorted(r["donors"]) and len(r["donors"]) == min(4, len(fit))
        assert all(abs(year.get(q, 0) - r["year"]) <= fit[:8][-1] for q in r["donors"])
