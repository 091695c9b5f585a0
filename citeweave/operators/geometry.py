"""Reference-relative novelty: how far a paper's vector lies from the cone of its references' vectors.

A paper's references are capped (MAX_REFS) and gathered into one row with its own vector, so non-negative least squares
runs over batches of papers, on the Gram matrix of each. Everything else is column arithmetic. Vectors are centred on
the mean of all before they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import scores, vectors
from citeweave.operators.dense import top_similar
from citeweave.operators.graph import key_sql, keyed
from citeweave.session import cut, table

# Fixed values.
MAX_REFS, MIN_REFS, TOP_SHARES, TOLERANCE = 80, 3, 8, 1e-10
MIN_COHORT = 20
#: Added to the diagonal of a system of equations, which repeated references would make singular.
RIDGE = 1e-12
DRAWS, MIN_POOL, NULLS = 30, 10, ("m", "a", "r2", "delta", "spread")
# Parts in which a ring is numbered, and papers of a ring that are compared in one group.
PARTS, BLOCK = 32, 32
MODEL = "mini-embed-64"


def nnls(gram: np.ndarray, b: np.ndarray, tol: float = TOLERANCE) -> np.ndarray:
    """Weights x >= 0 that minimise x'Gx - 2b'x, by an active set; G is positive semidefinite."""
    n = len(b)
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n + 10):
        w = b - gram @ x
        w[active] = -np.inf
        j = int(np.argmax(w)) if n else 0
        if not n or w[j] <= tol:
            break
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            some = gram[np.ix_(idx, idx)]
            some.flat[:: len(idx) + 1] += RIDGE
            s = np.linalg.solve(some, b[idx])
            if s.min() > tol:
                x[:] = 0
                x[idx] = s
                break
            bad = s <= tol
            step = np.min(x[idx][bad] / np.maximum(x[idx][bad] - s[bad], 1e-300))
            x[idx] += step * (s - x[idx])
            drop = idx[(x[idx] <= tol) & bad]
            x[drop], active[drop] = 0, False
            if not active.any():
                break
    return x


def profile(x: np.ndarray, refs: np.ndarray) -> dict:
    """Measures of the unit vector x against the unit rows of refs: m, r2, delta, weights, spread, centroid terms, chance."""
    cos = refs @ x
    gram = refs @ refs.T
    lam = nnls(gram, cos)
    r2 = float(np.clip(lam @ gram @ lam, 0.0, 1.0))
    m = float(cos.max())
    delta = r2 - max(m, 0.0) ** 2
    delta = 0.0 if -1e-9 < delta < 0 else delta
    d = 1 - gram[np.triu_indices(len(refs), 1)]
    mean = refs.mean(0)
    norm = float(np.linalg.norm(mean))
    return {
        "m": m, "parent": int(cos.argmax()), "r2": r2, "delta": delta, "lam": lam, "residual": float(np.sqrt(max(0.0, 1 - r2))),
        "spread": float(np.median(d)) if len(d) else float("nan"), "a": float(x @ mean / norm) if norm > 1e-12 else 0.0, "c": norm**2, "chance": min(1.0, len(refs) / len(x)),
    }


def best_vectors(paper_vectors: DataFrame, model: str = MODEL) -> DataFrame:
    """(id, vec): one usable unit vector per paper of the model, the latest embedded; ids in one spelling."""
    ok = paper_vectors.where((F.col("model") == model) & (F.size("vector") == F.col("dim")) & vectors.finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    ok = keyed(ok.select("canonical_id", "vec_id", "vector", "embedded_at"), "canonical_id").where("canonical_id is not null")
    best = ok.groupBy("canonical_id").agg(F.max_by("vector", F.struct(F.col("embedded_at").isNotNull(), "embedded_at", -F.col("vec_id"))).alias("v"))
    return best.select(F.col("canonical_id").alias("id"), vectors.unit(F.col("v")).alias("vec"))


def mean_vector(vecs: DataFrame, least: int = MIN_COHORT) -> DataFrame:
    """(pos, mean): the mean of all vectors, component by component; no rows from fewer than `least` vectors."""
    exploded = vecs.select(F.posexplode("vec").alias("pos", "v"))
    return exploded.groupBy("pos").agg(F.avg("v").alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least).select("pos", "mean")


def centred(vecs: DataFrame, least: int = MIN_COHORT) -> DataFrame:
    """(id, vec): vectors minus the mean of all, brought to unit length; as they are if there are fewer than `least`.

    Vectors that equal the mean have no direction and are left out.
    """
    mean = mean_vector(vecs, least).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("_m"))  # one row of dim numbers
    moved = vecs.crossJoin(F.broadcast(mean)).withColumn("vec", F.when(F.size("_m") > 0, F.zip_with("vec", "_m", lambda x, y: x - y)).otherwise(F.col("vec")))
    return moved.select("id", vectors.unit(F.col("vec")).alias("vec")).where(vectors.norm(F.col("vec")) > 0.5)


def reference_vectors(refs: DataFrame, vecs: DataFrame, max_refs: int = MAX_REFS) -> DataFrame:
    """(focal, ref, x, y): the vectors of papers and their references, at most max_refs of each in hashed order."""
    capped = _capped(refs, vecs, max_refs)
    return capped.join(vecs.select(F.col("id").alias("focal"), F.col("vec").alias("x")), "focal").select("focal", "ref", "x", "y")


def _capped(refs: DataFrame, vecs: DataFrame, max_refs: int) -> DataFrame:
    e = keyed(refs.select("focal_id", "ref_id"), "focal_id", "ref_id").where("focal_id is not null and ref_id is not null and focal_id != ref_id").distinct()
    y = vecs.select(F.col("id").alias("ref_id"), F.col("vec").alias("y"))
    w = Window.partitionBy("focal_id").orderBy(F.xxhash64("ref_id", F.lit(17)), "ref_id")
    return e.join(y, "ref_id").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_refs).select(F.col("focal_id").alias("focal"), F.col("ref_id").alias("ref"), "y")


def reference_sets(refs: DataFrame, vecs: DataFrame, max_refs: int = MAX_REFS) -> DataFrame:
    """(focal, x, refs, ys): one row per paper with a vector and a reference that has one: reference_vectors, gathered."""
    sets = _capped(refs, vecs, max_refs).groupBy("focal").agg(F.array_sort(F.collect_list(F.struct("ref", "y"))).alias("l"))  # up to max_refs
    x = vecs.select(F.col("id").alias("focal"), F.col("vec").alias("x"))
    return sets.join(x, "focal").select("focal", "x", F.transform("l", lambda r: r["ref"]).alias("refs"), F.transform("l", lambda r: r["y"]).alias("ys"))


def profiles(sets: DataFrame, min_refs: int = MIN_REFS) -> DataFrame:
    """One row per paper (focal, x, refs, ys) with its measures; fewer than min_refs references give status `too_few` and null measures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [x.split()[0] for x in _PROFILE.split(", ")]
        for b in batches:
            rows = []
            for focal, x, refs, ys in zip(b["focal"], b["x"], b["refs"], b["ys"]):
                row = {"focal": focal, "n_refs": len(refs), "status": "too_few"}
                if len(refs) >= min_refs:
                    p = profile(np.asarray(x, float), np.stack(ys).astype(float))
                    shares = p["lam"] / p["lam"].sum() if p["lam"].sum() > 0 else p["lam"]
                    top = [i for i in np.argsort(-shares, kind="stable")[:TOP_SHARES] if shares[i] > 1e-8]
                    row |= {k: p[k] for k in ("m", "r2", "delta", "residual", "spread", "a", "c", "chance")}
                    row |= {"status": "ok", "parent": refs[p["parent"]], "shares": " ".join(f"{refs[i]}={shares[i]:.4f}" for i in top), "lam_sum": float(p["lam"].sum())}
                rows.append([row.get(c) for c in cols])
            yield pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(cols)})

    return sets.mapInPandas(run, _PROFILE)


_PROFILE = "focal string, n_refs long, status string, m double, r2 double, delta double, residual double, spread double, a double, c double, chance double, parent string, shares string, lam_sum double"


def projections(sets: DataFrame, min_refs: int = MIN_REFS) -> DataFrame:
    """(focal, role, id, px, py): each paper, its references and its reconstruction in the plane of its closest parent and the rest of its reconstruction."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for focal, x, refs, ys in zip(b["focal"], b["x"], b["refs"], b["ys"]):
                if len(refs) < min_refs:
                    continue
                x, y = np.asarray(x, float), np.stack(ys).astype(float)
                p = profile(x, y)
                e1 = y[p["parent"]]
                hat = p["lam"] @ y
                e2 = hat - (hat @ e1) * e1
                n = np.linalg.norm(e2)
                e2 = e2 / n if n > 1e-9 else np.zeros_like(e1)
                points = [("focal", focal, x), ("reconstruction", focal, hat), *(("reference", r, v) for r, v in zip(refs, y))]
                rows += [(focal, role, i, float(v @ e1), float(v @ e2)) for role, i, v in points]
            yield pd.DataFrame(rows, columns=["focal", "role", "id", "px", "py"])

    return sets.mapInPandas(run, "focal string, role string, id string, px double, py double")


def null_donors(papers: DataFrame, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """(focal, level, year, r, ids, pool, n_ok, donors): `draws` papers whose references can stand in for those of each paper.

    papers has (focal, year, n, ids): n references with hashed ids. A donor has at least n (`level`) references that the
    paper neither has nor is. Donors are looked for in the order of the distance in years, within a year along a ring
    that starts behind the paper, until 2 x draws fit or all have been seen; `draws` of those are taken in hashed order.
    Each paper stands in the rings of all levels up to its own n, so at most MAX_REFS times.
    """
    part = F.pmod(F.xxhash64("focal", F.lit(seed)), F.lit(PARTS))
    r = papers.select("focal", "year", part.alias("_part"), "n", F.explode(F.sequence(F.lit(MIN_REFS), F.greatest("n", F.lit(MIN_REFS)))).alias("level")).where("level <= n")
    before = Window.partitionBy("level", "year").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows
    parts = r.groupBy("level", "year", "_part").agg(F.count("*").alias("_c"))
    parts = parts.withColumn("_from", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    w = Window.partitionBy("level", "year", "_part").orderBy(F.xxhash64("focal", F.lit(seed), F.lit(1)), "focal")
    ring = cut(r.withColumn("_rn", F.row_number().over(w)).join(parts, ["level", "year", "_part"]).select("focal", "n", "level", "year", (F.col("_from") + F.col("_rn") - 1).alias("r")))
    c = parts.groupBy("level", "year").agg(F.sum("_c").alias("c"))
    o = c.select("level", F.col("year").alias("_year"), F.col("c").alias("_c"))
    near = Window.partitionBy("level", "year").orderBy(F.abs(F.col("year") - F.col("_year")), "_year").rowsBetween(Window.unboundedPreceding, -1)  # a row per year
    own = (F.col("year") == F.col("_year")).cast("int")
    plan = cut(c.join(o, "level").select("level", "year", "_year", "_c", own.alias("_own"), (F.col("_c") - own).alias("_take")).withColumn("_start", F.coalesce(F.sum("_take").over(near), F.lit(0))))
    pools = c.groupBy("level").agg((F.sum("c") - 1).alias("pool"))
    at = ring.select(F.col("focal").alias("donor"), F.col("n").alias("_n"), "level", F.col("year").alias("_year"), F.col("r").alias("_pos"))
    ids = papers.select(F.col("focal").alias("donor"), F.col("ids").alias("_ids"))
    todo = ring.where("level = n").select("focal", "level", "year", "r").join(papers.select("focal", "ids"), "focal").join(F.broadcast(pools), "level")  # a row per level
    out, hi = None, 2 * draws
    while True:
        seen = todo.join(F.broadcast(plan.where(F.col("_start") < hi)), ["level", "year"]).where("_take > 0")  # levels x years
        seen = seen.withColumn("_off", F.explode(F.sequence(F.lit(0).cast("long"), F.least("_take", hi - F.col("_start")) - 1)))
        seen = seen.select("focal", "level", "ids", (F.col("_start") + F.col("_off")).alias("_seq"), "_year", F.pmod(F.col("r") + F.col("_off") + F.col("_own"), F.col("_c")).alias("_pos"))
        seen = seen.join(at, ["level", "_year", "_pos"]).join(ids, "donor")
        shared = F.size(F.array_intersect("_ids", F.array_append("ids", F.xxhash64("focal"))))
        fit = seen.where(F.col("_n") - shared >= F.col("level")).groupBy("focal").agg(F.count("*").alias("n_ok"), F.array_sort(F.collect_list(F.struct("_seq", "donor"))).alias("_l"))  # up to hi a paper
        head = F.array_sort(F.transform(F.slice("_l", 1, 2 * draws), lambda x: F.struct(F.xxhash64("focal", x["donor"], F.lit(seed)).alias("h"), x["donor"].alias("donor"))))
        fit = fit.select("focal", "n_ok", F.transform(F.slice(head, 1, draws), lambda x: x["donor"]).alias("donors"))
        got = cut(todo.join(fit, "focal", "left").withColumns({"n_ok": F.coalesce("n_ok", F.lit(0)), "donors": F.coalesce("donors", F.array().cast("array<string>"))}))
        short = (F.col("n_ok") < 2 * draws) & (F.col("pool") > hi)
        out = got.where(~short) if out is None else out.unionByName(got.where(~short))
        todo = got.where(short).drop("n_ok", "donors")
        if todo.isEmpty():
            return out
        hi *= 4


def null_percentiles(pairs: DataFrame, years: DataFrame, draws: int = DRAWS, seed: int = 0, min_pool: int = MIN_POOL) -> DataFrame:
    """(focal, status, n_null, pct_m, pct_a, pct_r2, pct_delta, pct_spread) of each paper in pairs: shares of null profiles below the observed one.

    A null profile is that of the paper against as many references, in hashed order, of one of its null_donors. Under
    min_pool profiles the status is `null_pool_too_small`, under MIN_REFS references `too_few`, and the shares are null.
    Papers of a ring go to the Python workers in blocks of BLOCK with the references of the block's donors.
    """
    size = pairs.groupBy("focal").agg(F.count("*").alias("n"), F.collect_list(F.xxhash64("ref")).alias("ids"))  # up to MAX_REFS
    papers = cut(size.join(years.select("focal", "year"), "focal", "left").withColumn("year", F.coalesce("year", F.lit(0))))
    block = F.struct("level", "year", F.floor(F.col("r") / BLOCK).alias("b")).alias("block")
    chosen = cut(null_donors(papers, draws, seed).where(F.size("donors") >= min_pool).select(block, "focal", "level", F.array_append("ids", F.xxhash64("focal")).alias("own"), "donors"))
    x = pairs.groupBy("focal").agg(F.any_value("x").alias("x"))
    y = pairs.select(F.col("focal").alias("donor"), "y", F.xxhash64("ref").alias("id"), F.xxhash64("focal", "ref", F.lit(seed)).alias("h"))
    given = chosen.select(F.col("block").alias("of"), F.explode(F.array_append("donors", F.col("focal"))).alias("donor")).distinct().join(y, "donor")

    def run(f: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        sets = {k: (g["id"].to_numpy(), np.stack(g["y"].to_numpy()).astype(float)) for k, g in d.sort_values(["donor", "h", "id"]).groupby("donor")}
        rows = []
        for focal, level, v, own, donors in zip(f["focal"], f["level"], f["x"], f["own"], f["donors"]):
            v = np.array(v, float)
            seen = profile(v, sets[focal][1])
            null = [profile(v, vecs[~np.isin(ids, own)][:level]) for ids, vecs in (sets[donor] for donor in donors)]
            rows.append((focal, len(null), *(round(sum(p[c] < seen[c] for p in null) / len(null), 6) for c in NULLS)))
        return pd.DataFrame(rows, columns=["focal", "n_null", *(f"pct_{c}" for c in NULLS)])

    left = chosen.join(x, "focal").select("block", "focal", "level", "x", "own", "donors")
    pct = left.groupBy("block").cogroup(given.groupBy("of")).applyInPandas(run, "focal string, n_null long, " + ", ".join(f"pct_{c} double" for c in NULLS))
    status = F.when(F.col("n") < MIN_REFS, F.lit("too_few")).when(F.col("n_null").isNull(), F.lit("null_pool_too_small")).otherwise(F.lit("ok"))
    return papers.join(pct, "focal", "left").select("focal", status.alias("status"), F.coalesce("n_null", F.lit(0)).alias("n_null"), *(f"pct_{c}" for c in NULLS))


def _vecs(spark, d: str) -> DataFrame:
    return cut(centred(cut(best_vectors(table(spark, d, "paper_vectors")))))


def _pairs(spark, d: str) -> DataFrame:
    return reference_vectors(table(spark, d, "ref_edges"), _vecs(spark, d))


def _sets(spark, d: str) -> DataFrame:
    return reference_sets(table(spark, d, "ref_edges"), _vecs(spark, d))


def _named(p: DataFrame) -> DataFrame:
    """profiles with discovery mode and typology."""
    cls = scores.geometry_class(F.col("m"), F.col("delta"), F.col("r2"))
    typ = scores.typology(F.col("m"), F.col("delta"), F.col("r2"), F.col("chance"), F.col("spread"))
    return p.withColumn("mode", F.when(F.col("status") == "ok", cls)).withColumn("typology", typ)


def _q_profiles(spark, d):
    return _named(profiles(_sets(spark, d)))


def resumed(papers: DataFrame, done: DataFrame, sets: DataFrame, min_refs: int = MIN_REFS) -> DataFrame:
    """A batch run that goes on where another stopped: profiles of the papers (focal) that `done` (focal, status) has not scored, one row each.

    Papers with status ok or too_few in done are left out; a paper without a vector or without a reference that has one
    gets status no_vectors, so that a run leaves a row for each paper it was asked for.
    """
    left = papers.select("focal").distinct().join(done.where(F.col("status").isin("ok", "too_few")).select("focal"), "focal", "left_anti")
    scored = profiles(left.join(sets, "focal"), min_refs)
    return left.join(scored, "focal", "left").withColumn("status", F.coalesce("status", F.lit("no_vectors")))


def _q_resumed(spark, d):
    """The papers of the fetch log, those whose fetch went well being scored already; statuses and how many of each."""
    log = keyed(table(spark, d, "fetch_status").select("canonical_id", "status"), "canonical_id").where("canonical_id is not null").select(F.col("canonical_id").alias("focal"), "status")
    run = resumed(log, log, _sets(spark, d))
    return run.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_refs", F.lit(0))).cast("long").alias("n_refs"))


def _q_closest(spark, d):
    cos = F.round(vectors.dot(F.col("x"), F.col("y")), 9)
    p = _pairs(spark, d).withColumn("cos", cos)
    return p.groupBy("focal").agg(F.count("*").alias("n_refs"), F.round(F.max("cos"), 6).alias("m"), F.max_by("ref", F.struct("cos", "ref")).alias("parent"))


def _q_dispersion(spark, d):
    p = _pairs(spark, d).select("focal", "ref", "y")
    both = p.alias("a").join(p.alias("b"), "focal").where("a.ref < b.ref")  # at most MAX_REFS squared per paper
    dist = both.select("focal", F.round(1 - vectors.dot(F.col("a.y"), F.col("b.y")), 9).alias("dist"))
    q = lambda x: F.round(F.percentile("dist", F.lit(x)), 6)
    return dist.groupBy("focal").agg(q(0.5).alias("q50"), q(0.9).alias("q90"))


def _q_projections(spark, d):
    return projections(_sets(spark, d))


def _q_null(spark, d):
    p = keyed(table(spark, d, "papers").select("canonical_id", "year"), "canonical_id")
    years = p.where("canonical_id is not null").groupBy(F.col("canonical_id").alias("focal")).agg(F.coalesce(F.max("year"), F.lit(0)).alias("year"))
    return null_percentiles(_pairs(spark, d), years)


def _q_mean(spark, d):
    return mean_vector(best_vectors(table(spark, d, "paper_vectors"))).select("pos", F.round("mean", 6).alias("mean"))


def moments(vecs: DataFrame, by: str, vec: str) -> DataFrame:
    """(by, i, j, n, xy, x, y): per group and pair of components, the number of vectors, the sum of products and both sums.

    A task adds up its vectors' outer products, so that what is shuffled is d x d numbers per task and group. Vectors
    of a group have one length; null vectors are left out.
    """
    kind = dict(vecs.dtypes)[by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for key, g in b.groupby("k", dropna=False):
                x = np.stack(g["v"].to_numpy()).astype(float)
                n, s, xy = sums.get(key, (0, 0.0, 0.0))
                sums[key] = (n + len(x), s + x.sum(0), xy + x.T @ x)
        for key, (n, s, xy) in sums.items():
            yield pd.DataFrame({"k": [key], "n": [n], "s": [s], "xy": [xy.ravel()]})

    each = vecs.where(F.col(vec).isNotNull()).select(F.col(by).alias("k"), F.col(vec).alias("v")).mapInPandas(run, f"k {kind}, n long, s array<double>, xy array<double>")
    cells = each.select("k", "n", F.posexplode("xy").alias("pos", "xy"), "s")
    d = F.size("s")
    i, j = F.floor(F.col("pos") / d).cast("int"), (F.col("pos") % d).cast("int")
    return cells.groupBy(F.col("k").alias(by), i.alias("i"), j.alias("j")).agg(F.sum("n").alias("n"), F.sum("xy").alias("xy"), F.sum(F.get("s", i)).alias("x"), F.sum(F.get("s", j)).alias("y"))


def _q_effective_dim(spark, d):
    """trace(C)^2 / |C|_F^2 of the covariance of the vectors of each label, from sums of products of components."""
    m = moments(table(spark, d, "embeddings"), "label", "embedding")
    cov = m.withColumn("c", F.col("xy") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n"))
    t = F.sum(F.when(F.col("i") == F.col("j"), F.col("c")))
    return cov.groupBy("label").agg(F.max("n").alias("n"), F.round(F.pow(t, F.lit(2.0)) / F.sum(F.col("c") * F.col("c")), 6).alias("d_eff"))


def _q_finite(spark, d):
    v = table(spark, d, "paper_vectors")
    ok = vectors.finite(F.col("vector"))
    return v.groupBy("model", "dim").agg(F.count("*").alias("rows"), F.count_if(ok & (F.size("vector") == F.col("dim"))).alias("usable"), F.count_if(F.coalesce(F.size("vector") != F.col("dim"), F.lit(True))).alias("wrong_size"))


def _q_truncated(spark, d):
    e = table(spark, d, "embeddings")
    t = vectors.truncated(F.col("embedding"), 16)
    return e.select("vec_id", F.size(t).cast("long").alias("dim"), F.round(vectors.norm(t), 6).alias("norm"), F.round(F.element_at(t, 1), 6).alias("x1"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm_full"))


DIMS = (8, 16, 32, 64)


def _q_dims(spark, d):
    """For each dim, how well the nearest same-label neighbours are kept: queries are ids divisible by 50, against all rows; one pass."""
    e = table(spark, d, "embeddings")
    top = top_similar(e, e.where("vec_id % 50 = 0"), 10, dims=DIMS)
    lab = e.select("vec_id", "label")
    both = top.join(lab, "vec_id").join(lab.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q")
    same = F.col("label") == F.col("ql")
    per = both.groupBy("variant", "q").agg(F.max(same.cast("double")).alias("hit"), F.coalesce(F.max(F.when(same, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    dim = F.element_at(F.array(*(F.lit(x) for x in DIMS)), F.col("variant") + 1)
    return per.groupBy(dim.alias("dim")).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("hit"), 6).alias("hit10"))


_VECS = f"""v AS (SELECT id, list_transform(vector, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(vector, lambda z: z::DOUBLE * z::DOUBLE)))) AS vec FROM (
  SELECT {key_sql('canonical_id')} AS id, * FROM paper_vectors WHERE model = '{MODEL}' AND len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)
  WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY embedded_at DESC NULLS LAST, vec_id) = 1)"""
_UNIT = "list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"
_CENTRED = f"{_VECS.replace('v AS (', 'v0 AS (', 1)}, cm AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m, count(*) AS n FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v0) GROUP BY 1) WHERE n >= 20), v1 AS (SELECT id, CASE WHEN m IS NULL THEN vec ELSE list_transform(list_zip(vec, m), lambda z: z[1] - z[2]) END AS w FROM v0, cm), v AS (SELECT id, {_UNIT.format(v='w')} AS vec FROM v1 WHERE list_inner_product(w, w) > 1e-24)"
_PAIRS = f"WITH {_CENTRED}, e AS (SELECT DISTINCT f, r FROM (SELECT {key_sql('focal_id')} AS f, {key_sql('ref_id')} AS r FROM ref_edges) WHERE f IS NOT NULL AND r IS NOT NULL AND f <> r), p AS (SELECT f AS focal, r AS ref, a.vec AS x, b.vec AS y FROM e JOIN v b ON b.id = r JOIN v a ON a.id = f)"
QUERIES = {
    "nov4_nov5_nov7_nov8_profiles": _q_profiles,
    "nov2_closest_parent": _q_closest,
    "nov3_dispersion": _q_dispersion,
    "nov10_projections": _q_projections,
    "nov12_resumed_batch": _q_resumed,
    "nov9_null_percentiles": _q_null,
    "agg24_mean_vector": _q_mean,
    "agg25_effective_dimension": _q_effective_dim,
    "flt12_finite_vectors": _q_finite,
    "arr1_truncated": _q_truncated,
    "evl16_dimension_sweep": _q_dims,
}
SQL = {
    "nov2_closest_parent": _PAIRS + ", c AS (SELECT *, round(list_inner_product(x, y), 9) AS cos FROM p) SELECT focal, count(*) AS n_refs, round(max(cos), 6) AS m, (list(ref ORDER BY cos DESC, ref DESC))[1] AS parent FROM c GROUP BY 1 HAVING count(*) <= 80",
    "nov3_dispersion": _PAIRS + ", c AS (SELECT a.focal, round(1 - list_inner_product(a.y, b.y), 9) AS dist FROM p a JOIN p b ON a.focal = b.focal AND a.ref < b.ref) SELECT focal, round(quantile_cont(dist, 0.5), 6) AS q50, round(quantile_cont(dist, 0.9), 6) AS q90 FROM c GROUP BY 1",
    "nov12_resumed_batch": _PAIRS + f", log AS (SELECT {key_sql('canonical_id')} AS focal, status FROM fetch_status), todo AS (SELECT DISTINCT focal FROM log WHERE focal IS NOT NULL AND focal NOT IN (SELECT focal FROM log WHERE focal IS NOT NULL AND status = 'ok')), k AS (SELECT focal, least(80, count(*)) AS n FROM p GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'no_vectors' WHEN n < 3 THEN 'too_few' ELSE 'ok' END AS status, count(*) AS n, sum(coalesce(n, 0))::BIGINT AS n_refs FROM todo LEFT JOIN k USING (focal) GROUP BY 1",
    "agg24_mean_vector": f"WITH {_VECS} SELECT pos - 1 AS pos, round(avg(x), 6) AS mean FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM v) GROUP BY 1",
    "agg25_effective_dimension": "WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT a.label, a.i, b.i AS j, avg(a.x * b.x) - avg(a.x) * avg(b.x) AS c, count(*) AS n FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY ALL) SELECT label, max(n) AS n, round(pow(sum(c) FILTER (i = j), 2) / sum(c * c), 6) AS d_eff FROM c GROUP BY 1",
    "flt12_finite_vectors": "SELECT model, dim, count(*) AS rows, count(*) FILTER (len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS usable, count(*) FILTER (vector IS NULL OR len(vector) <> dim) AS wrong_size FROM paper_vectors GROUP BY 1, 2",
    "arr1_truncated": "WITH t AS (SELECT *, embedding[:16]::DOUBLE[] AS h FROM embeddings) SELECT vec_id, 16::BIGINT AS dim, 1.0::DOUBLE AS norm, round(h[1] / sqrt(list_inner_product(h, h)), 6) AS x1, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm_full FROM t",
    "evl16_dimension_sweep": "WITH d AS (SELECT unnest([8, 16, 32, 64]) AS dim), s AS (SELECT dim, q.vec_id AS q, q.label AS ql, e.vec_id, e.label, round(list_inner_product(q.embedding[:dim]::DOUBLE[], e.embedding[:dim]::DOUBLE[]) / CASE WHEN dim = 64 THEN 1 ELSE sqrt(list_inner_product(q.embedding[:dim]::DOUBLE[], q.embedding[:dim]::DOUBLE[])) * sqrt(list_inner_product(e.embedding[:dim]::DOUBLE[], e.embedding[:dim]::DOUBLE[])) END, 9) AS s FROM d, embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY dim, q ORDER BY s DESC, vec_id) AS rank FROM s), p AS (SELECT dim, q, max((label = ql)::INT)::DOUBLE AS hit, coalesce(max(CASE WHEN label = ql THEN 1.0::DOUBLE / rank END), 0) AS rr FROM t WHERE rank <= 10 GROUP BY 1, 2) SELECT dim, round(avg(rr), 6) AS mrr, round(avg(hit), 6) AS hit10 FROM p GROUP BY 1",
}
