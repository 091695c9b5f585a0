"""Most similar vectors for every vector.

Vectors are placed in regions around centroids fitted on a bounded sample; every vector is indexed and every vector is
a query. A region is cut into tiles of bounded size. In a tile, vectors are one-bit codes of a random rotation: the
inner product is estimated from packed bits and a correction scalar per vector, with an error bound; only vectors
whose bound reaches the query's k-th similarity so far are compared exactly. Each query is answered in its own tile
first, where its vector lies anyway; the k-th similarity found there decides which other regions can hold a nearer
vector, and the query is sent to their tiles only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.session import cut, table

#: Bytes of the sample of a model that centroids are fitted on, at most, and vectors of it per region.
SAMPLE_BYTES, PER_CENTROID = 64_000_000, 100
#: Vectors of a region on average, if the sample allows so many regions.
PER_REGION = 6000
#: Regions in which a query looks at most; in which it looks first if its own holds nothing nearer than chance would
#: give; and in which it looks if that is still so afterwards.
PROBES, FIRST_PROBES, LOOSE_PROBES = 16, 4, 32
#: Standard deviations of chance in the rule that leaves out regions too far off to hold a vector above the floor.
REGION_EPSILON = 2.5
#: Vectors of a tile, about, and queries of one task: with more, the tile is repeated.
BLOCK, QUERIES_AT_ONCE = 12_000, 16_384
#: Keys of repeated papers that are broadcast; with more, all vectors are grouped by key.
REPEATED_ROWS = 500_000
#: Standard deviations of the estimate's error that the bounds allow.
EPSILON = 3.0
SEED = 20_240


def _usable(df: DataFrame) -> DataFrame:
    """(model, id, dim, vec, order) of the usable rows; the last of a paper has the largest order."""
    fit = (F.size("vector") == F.col("dim")) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    ok = df.where(F.col("canonical_id").isNotNull() & F.col("model").isNotNull() & F.coalesce(fit, F.lit(False)))
    order = F.struct(F.coalesce(F.unix_micros("embedded_at"), F.lit(-(2**62))), -F.col("vec_id"))
    return ok.select("model", F.col("canonical_id").alias("id"), "dim", F.col("vector").alias("vec"), order.alias("order"))


def usable_vectors(df: DataFrame) -> DataFrame:
    """(model, id, dim, vec): the usable vectors, of each canonical_id and model the one embedded last.

    Unusable are null vectors, those of a length other than dim, with a null or non-finite component, all zero, or
    without canonical_id or model. Ties go to the smallest vec_id; a null embedded_at is the oldest. Only the vectors of
    papers that have several are shuffled, as long as the keys of those are few enough to be broadcast.
    """
    ok, key = _usable(df), ["model", "id"]
    last = lambda x: x.groupBy(*key).agg(F.max_by(F.struct("dim", "vec"), "order").alias("v")).select(*key, "v.dim", "v.vec")
    several = cut(ok.groupBy(*key).count().where("count > 1").select(*key))
    if several.count() > REPEATED_ROWS:
        return last(ok)
    several = F.broadcast(several)
    return ok.join(several, key, "left_anti").select(*key, "dim", "vec").unionByName(last(ok.join(several, key, "left_semi")))


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for each call."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the unit vectors x."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def _stack(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_numpy()).astype(np.float64)


def encode(x: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scalars): packed sign bits of the rotated unit vectors and <code, vector> of each."""
    y = x @ rot.T
    pad = -len(rot) % 64
    bits = np.packbits(np.pad(y > 0, ((0, 0), (0, pad))), axis=1)
    return bits.view(np.uint64), np.abs(y).sum(1) / math.sqrt(len(rot))


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    """The packed codes as rows of -1 and 1."""
    bits = np.unpackbits(codes.view(np.uint8), axis=1)[:, :dim]
    return bits.astype(np.float32) * 2 - 1


def corrected(codes: np.ndarray, scalars: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, errors): what a rotated query is multiplied with to estimate its inner products, and EPSILON standard deviations of that."""
    rows = signs(codes, dim) * (1 / (math.sqrt(dim) * scalars)).astype(np.float32)[:, None]
    return rows, (EPSILON * np.sqrt(np.maximum(0, 1 - scalars**2)) / scalars / math.sqrt(max(1, dim - 1))).astype(np.float32)


def estimate(q: np.ndarray, codes: np.ndarray, scalars: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, errors) of the inner products of queries and coded vectors."""
    rows, errors = corrected(codes, scalars, len(rot))
    return (q @ rot.T).astype(np.float32) @ rows.T, errors[None, :]


def _chosen(q: np.ndarray, d: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cos): where mask holds, the columns of each row with its k largest cosines and all ties with the k-th."""
    many = mask.sum(1) > max(8, 0.05 * mask.shape[1])
    x, y = np.nonzero(mask & ~many[:, None])
    cos = np.concatenate([np.einsum("ij,ij->i", q[x[j : j + 100_000]], d[y[j : j + 100_000]]) for j in range(0, len(x), 100_000)]) if len(x) else np.empty(0)
    rows = np.nonzero(many)[0]
    if not len(rows):
        return x, y, np.round(cos, 9)
    c = np.where(mask[rows], q[rows] @ d.T, -9.0)
    kth = np.partition(c, -k, axis=1)[:, -k] if c.shape[1] > k else np.full(len(rows), -8.0)
    a, b = np.nonzero(c >= np.maximum(kth, -8)[:, None] - 2e-9)
    return np.concatenate([x, rows[a]]), np.concatenate([y, b]), np.round(np.concatenate([cos, c[a, b]]), 9)


def nearest_in_tile(data: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(q, n, cos): of each query the k nearest vectors of the tile, itself left out; ties go to the smaller id.

    Vectors below the query's floor may be left out.
    """
    data, queries = data.sort_values("id"), queries.sort_values("id")
    d, q = unit(_stack(data["vec"])), unit(_stack(queries["vec"]))
    ids, qids, floor = data["id"].to_numpy(), queries["id"].to_numpy(), queries["floor"].to_numpy(np.float32)
    at = pd.Series(np.arange(len(ids)), index=ids).reindex(qids).to_numpy()
    rot = rotation(d.shape[1])
    rows, errors = corrected(*encode(d, rot), len(rot))
    turned = (q @ rot.T).astype(np.float32)
    out_q, out_n, out_c = [], [], []
    step = max(1, 2_000_000 // max(1, len(d)))
    for i in range(0, len(q), step):
        s = slice(i, i + step)
        est = turned[s] @ rows.T
        own = at[s]
        has = ~np.isnan(own)
        est[np.nonzero(has)[0], own[has].astype(int)] = -9
        bar = floor[s].copy()
        free = np.nonzero(bar < -1)[0]
        if len(free) and len(d) > k:
            bar[free] = np.maximum(np.partition(est[free] - errors, -k, axis=1)[:, -k], -8)
        x, y, cos = _chosen(q[s], d, (est + errors >= bar[:, None] - 1e-4) & (est > -5), k)
        order = np.lexsort((y, -cos, x))
        x, y, cos = x[order], y[order], cos[order]
        start = np.searchsorted(x, np.arange(len(est)))
        keep = np.arange(len(x)) - start[x] < k if len(x) else np.empty(0, bool)
        out_q.append(qids[s][x[keep]])
        out_n.append(ids[y[keep]])
        out_c.append(cos[keep])
    return pd.DataFrame({"q": np.concatenate(out_q), "n": np.concatenate(out_n), "cos": np.concatenate(out_c)})


class Regions:
    """Centroids of a space (vectors of one model and dim) and the number of tiles of each region."""

    def __init__(self, number: int, sample: np.ndarray, n: int):
        self.number, self.n, self.dim = number, n, sample.shape[1]
        self.centroids = fit_centroids(sample, max(1, min(round(n / PER_REGION), len(sample) // PER_CENTROID))).astype(np.float32)
        near = np.concatenate([(sample[i : i + 2048] @ self.centroids.T).argmax(1) for i in range(0, len(sample), 2048)])
        share = np.bincount(near, minlength=len(self.centroids)) / len(sample)
        self.tiles = np.maximum(1, np.ceil(share * n / BLOCK)).astype(np.int64)
        self.first = np.cumsum(self.tiles) - self.tiles

    def tile(self, region: np.ndarray, ids: pd.Series) -> np.ndarray:
        part = pd.util.hash_array(ids.to_numpy(dtype=object)).astype(np.uint64) % self.tiles[region].astype(np.uint64)
        return (self.number << 40) + self.first[region] + part.astype(np.int64)

    def to_ask(self, x: np.ndarray, own: np.ndarray, floor: np.ndarray, again: bool, probes: int, loose: int, epsilon: float) -> tuple[list[list[int]], np.ndarray]:
        """(tiles to ask, whether the floor is no better than chance) of each query, `again` after such a query's first look.

        A vector above the floor lies in a region other than the query's nearest only if the part of it that is
        orthogonal to the query, a direction as good as random, makes up for what that region's centroid is further
        off: regions beyond epsilon standard deviations of that are left out. A query whose floor is no better than
        chance has no such limit: it looks in FIRST_PROBES regions, and if that is still so in `loose`. Tiles asked
        before, its own among them, are not asked again.
        """
        near = x.astype(np.float32) @ self.centroids.T
        order = np.argsort(-near, axis=1)[:, : max(probes, loose)]
        near = np.take_along_axis(near, order, 1)
        f = np.clip(floor, 1e-6, 1.0)
        reach = np.sqrt(np.maximum(0, 1 - f * f)) / f * math.sqrt(2) * epsilon / math.sqrt(self.dim)
        free = floor <= min(0.999, math.sqrt(2 * math.log(max(2, self.n)) / self.dim))
        rank = np.arange(order.shape[1])[None, :]
        ask = np.where(free[:, None], rank < (loose if again else FIRST_PROBES), (rank < probes) & (near[:, :1] - near <= reach[:, None]))
        if again:
            ask &= rank >= FIRST_PROBES
        base = self.number << 40
        span = [range(base + int(a), base + int(a + n)) for a, n in zip(self.first, self.tiles)]
        return [[t for r in regions[chosen] for t in span[r] if t != o] for regions, chosen, o in zip(order, ask, own)], free


def _lists(found: pd.DataFrame, ids: np.ndarray) -> tuple[list, list]:
    """The neighbours and cosines of each of ids, as lists."""
    n, c = found.groupby("q", sort=False)["n"].agg(list), found.groupby("q", sort=False)["cos"].agg(list)
    return [n.get(i, []) for i in ids], [c.get(i, []) for i in ids]


def nearest(df: DataFrame, k: int = 5, probes: int = PROBES, loose: int = LOOSE_PROBES, epsilon: float = REGION_EPSILON) -> DataFrame:
    """(model, q, n, cos, rank): the k most similar papers of each paper of df (see usable_vectors).

    cos is rounded to 9 decimals; ties go to the smaller id; a paper alone in its model has no rows; an empty table
    gives none. Every vector is indexed and every vector is a query; a neighbour can be missed if it lies in none of
    the regions the query looks in (measured recall is in the README). With probes, loose and epsilon as large as can
    be every tile is asked: then only the error bounds of the codes can lose a neighbour.
    """
    spark = df.sparkSession
    ok = _usable(df)
    sizes = sorted(tuple(r) for r in ok.groupBy("model", "dim").count().collect())  # one row per model
    if not sizes:
        return spark.createDataFrame([], "model string, q string, n string, cos double, rank int")
    spaces, numbers = [], {}
    for number, (model, dim, n) in enumerate(sizes):
        most = min(SAMPLE_BYTES // (4 * dim), PER_CENTROID * max(1, round(n / PER_REGION)))
        some = ok.where((F.col("model") == model) & (F.col("dim") == dim)).orderBy(F.xxhash64("id", F.lit(SEED)), "id").select("vec").limit(most).toPandas()
        spaces.append(Regions(number, unit(_stack(some["vec"])), n))
        numbers[model, dim] = number
    shared = spark.sparkContext.broadcast(spaces)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["tile"] = np.int64(0)
            for (model, dim), rows in b.groupby(["model", "dim"]).groups.items():
                r = shared.value[numbers[model, dim]]
                near = unit(_stack(b.loc[rows, "vec"])).astype(np.float32) @ r.centroids.T
                b.loc[rows, "tile"] = r.tile(near.argmax(1), b.loc[rows, "id"])
            yield b[["tile", "id", "vec"]]

    def floors(cos) -> np.ndarray:
        return np.array([c[k - 1] if len(c) >= k else -9.0 for c in cos])

    def answer(t: pd.DataFrame) -> pd.DataFrame:
        """A tile asked by its own vectors: what they find, and which tiles they have to ask next."""
        own = int(t["tile"].iloc[0])
        t["ids"], t["cos"] = _lists(nearest_in_tile(t, t.assign(floor=-9.0), k), t["id"].to_numpy())
        t["more"], t["loose"] = shared.value[own >> 40].to_ask(unit(_stack(t["vec"])), t["tile"], floors(t["cos"]), False, probes, loose, epsilon)
        return t[["tile", "id", "vec", "more", "loose", "ids", "cos"]]

    def ask_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["more"] = pd.Series([[]] * len(b), index=b.index, dtype=object)
            for space, rows in b.groupby(b["tile"].to_numpy() >> 40).groups.items():
                more, _ = shared.value[space].to_ask(unit(_stack(b.loc[rows, "vec"])), b.loc[rows, "tile"], floors(b.loc[rows, "cos"]), True, probes, loose, epsilon)
                b.loc[rows, "more"] = pd.Series(more, index=rows, dtype=object)
            yield b[["tile", "id", "vec", "more", "cos"]]

    def look(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        is_q = t["floor"].notna()
        d, q = t[~is_q], t[is_q]
        if not len(d) or not len(q):
            return pd.DataFrame({"space": pd.Series(dtype="int32"), "id": pd.Series(dtype=object), "ids": pd.Series(dtype=object), "cos": pd.Series(dtype=object)})
        found = nearest_in_tile(d, q, k)
        hit = found["q"].unique()
        ids, cos = _lists(found, hit)
        return pd.DataFrame({"space": pd.Series([key[0] >> 40] * len(hit), dtype="int32"), "id": hit, "ids": ids, "cos": cos})

    placed = usable_vectors(df).mapInPandas(place, "tile long, id string, vec array<float>")
    first = cut(placed.groupBy("tile").applyInPandas(answer, "tile long, id string, vec array<float>, more array<long>, loose boolean, ids array<string>, cos array<double>"))

    def asked(queries: DataFrame) -> DataFrame:
        """(space, id, ids, cos): what the queries (id, vec, more, cos) find in the tiles of `more` above their floor."""
        sent = queries.select(F.explode("more").alias("tile"), "id", "vec", F.coalesce(F.get("cos", F.lit(k - 1)), F.lit(-9.0)).alias("floor"))
        counts = sent.groupBy("tile").count().collect()  # a row per tile
        if not counts:
            return spark.createDataFrame([], "space int, id string, ids array<string>, cos array<double>")
        parts = F.broadcast(spark.createDataFrame([(r["tile"], math.ceil(r["count"] / QUERIES_AT_ONCE)) for r in counts], "tile long, parts int"))
        data = first.select("tile", "id", "vec", F.lit(None).cast("double").alias("floor")).join(parts, "tile")
        data = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        sent = sent.join(parts, "tile").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        return data.unionByName(sent).drop("parts").groupBy("tile", "part").applyInPandas(look, "space int, id string, ids array<string>, cos array<double>")

    ordered = lambda c: F.slice(F.array_sort(F.transform(c, lambda x: F.struct((-x["cos"]).alias("c"), x["ids"].alias("n")))), 1, k)
    space = F.shiftright("tile", 40).cast("int").alias("space")
    pairs = lambda x: x.select("space", "id", F.arrays_zip("ids", "cos").alias("z"))
    base = first.select(space, "id", "ids", "cos", (F.size("more") > 0).alias("asked"))
    later = cut(asked(first))
    merge = lambda x: x.groupBy("space", "id").agg(F.flatten(F.collect_list("z")).alias("z"))  # noqa: E731  # k of each tile asked
    lost = first.where("loose and size(more) > 0").select("tile", "id", "vec", "cos", space)
    known = merge(pairs(later).unionByName(lost.select("space", "id", F.transform("cos", lambda c: F.struct(F.lit("").alias("ids"), c.alias("cos"))).alias("z"))))
    known = lost.drop("cos").join(known, ["space", "id"]).select("tile", "id", "vec", F.transform(ordered(F.col("z")), lambda x: -x["c"]).alias("cos"))
    again = cut(known.mapInPandas(ask_again, "tile long, id string, vec array<float>, more array<long>, cos array<double>").where("size(more) > 0"))
    merged = merge(pairs(base.where("asked")).unionByName(pairs(later)).unionByName(pairs(asked(again))))
    best = pairs(base.where("not asked")).unionByName(merged).select("space", "id", F.posexplode(ordered(F.col("z"))).alias("rank", "m"))
    name = F.create_map(*(x for (model, _), i in numbers.items() for x in (F.lit(i), F.lit(model))))
    return best.select(name[F.col("space")].alias("model"), F.col("id").alias("q"), F.col("m.n").alias("n"), (-F.col("m.c")).alias("cos"), (F.col("rank") + 1).alias("rank"))


def p5_found(spark, sf_dir: str) -> DataFrame:
    near = nearest(table(spark, sf_dir, "paper_vectors"))
    return near.select("model", F.least("q", "n").alias("id_a"), F.greatest("q", "n").alias("id_b")).distinct()


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
