"""Near-duplicate records with small edits.

Similarity is the multiset Jaccard of words. Equal bags of words are one class. Classes are put into size bands, since
sizes that differ by more than the threshold cannot be alike, and bands are cut into blocks of bounded size, each packed
into one row. Each pair of compatible blocks is a tile: one Spark group that compares hashed bitmaps. A bag's bitmap
holds the parity of its elements per hashed bit, so the bits in which two bitmaps differ are at most the elements in
which the bags differ, which bounds the overlap from above; no pair is lost. A bitmap is as long as its bag asks for;
a longer one is folded (its halves XORed) to be compared with a shorter one. The bags themselves are made again for
the pairs that pass, and their sorted arrays are intersected exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.session import cut, spread, table

_WORD = re.compile(r"[^\W_]+")
#: Bits of the shortest bitmap, and bits an element asks for at least, in a first look and in all; lengths are powers of two.
BITS, FIRST_LOOK, PER_ELEMENT = 128, 1.0, 2.0
#: Blocks that all classes make, about, so that each is sent to as many tiles at any size; and the bounds of a block: rows
#: and bytes. A task holds two blocks.
BLOCKS, BLOCK_MIN, BLOCK_MAX, BLOCK_BYTES = 10, 2048, 131_072, 16_000_000
#: Rows and columns of a tile that are compared at once.
ROWS, COLUMNS = 64, 1024
#: Band edges grow by the fourth root of 1 / threshold.
BANDS = 4
#: Classes of more equal records than this are linked to their smallest record only, not to each other.
EXPAND = 64


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters or digits, in lower case."""
    return _WORD.findall(text.lower())


def bits_of(size: int, per: float = PER_ELEMENT) -> int:
    """The length of the bitmap of a bag of so many elements."""
    return max(BITS, 1 << math.ceil(math.log2(max(1.0, per * size))))


def bitmap(elems: np.ndarray) -> np.ndarray:
    """Packed parities of the elements per bit, the low bits of an element being its place."""
    n = bits_of(len(elems))
    parity = np.bincount((elems & (n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view(np.uint64)


def bags(df: DataFrame, row_id: str, title: str, abstract: str, least: int, elements: bool = False) -> DataFrame:
    """(rec, bag, size, bits) of rows with a non-empty title and at least `least` words in the abstract.

    bag is equal for equal multisets; bits is the bitmap. With `elements`, (rec, elems) instead: the sorted hashes of
    (word, occurrence).
    """
    schema = "rec long, elems array<long>" if elements else "rec long, bag binary, size int, bits binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for b in batches:
            rows = []
            for r, t, a in zip(b["r"], b["t"], b["a"]):
                said = words(a)
                if not t.strip() or len(said) < least:
                    continue
                e = []
                for w, n in Counter(words(t) + said).items():
                    got = known.get(w, ())
                    if len(got) < n:
                        if len(known) > 500_000:
                            known.clear()
                        got = known[w] = [int.from_bytes(hashlib.blake2b(f"{w}\0{i}".encode(), digest_size=8).digest(), "little", signed=True) for i in range(n)]
                    if n == 1:
                        e.append(got[0])
                    else:
                        e += got[:n]
                x = np.array(e, dtype=np.int64)
                x.sort()
                rows.append((r, x) if elements else (r, hashlib.blake2b(x.tobytes(), digest_size=16).digest(), len(x), bitmap(x).tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    cols = df.select(F.col(row_id).cast("long").alias("r"), F.col(title).alias("t"), F.col(abstract).alias("a")).dropna()
    return cols.mapInPandas(run, schema)


class Block:
    """The classes of a block in the order of their sizes, with their bitmaps at every length asked for."""

    def __init__(self, reps: bytes, sizes: bytes, bits: bytes):
        self.rep, self.size = np.frombuffer(reps, dtype=np.int64), np.frombuffer(sizes, dtype=np.int64)
        self.n_words = np.array([bits_of(n) // 64 for n in np.unique(self.size)])[np.unique(self.size, return_inverse=True)[1]]
        self._bits, self._at, self._level = np.frombuffer(bits, dtype=np.uint64), np.cumsum(self.n_words) - self.n_words, {}

    def folded(self, rows: slice, n_words: int) -> np.ndarray:
        """(n_words, rows): bitmaps folded to n_words, which is at most the length of the first of rows."""
        if n_words not in self._level:
            first = int(np.searchsorted(self.n_words, n_words))
            out = np.zeros((n_words, len(self.rep)), dtype=np.uint64)
            for w in np.unique(self.n_words[first:]):
                i, j = np.searchsorted(self.n_words, [w, w + 1])
                x = self._bits[self._at[i] : self._at[i] + (j - i) * w].reshape(j - i, w)
                while x.shape[1] > n_words:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                out[:, i:j] = x.T
            self._level[n_words] = out
        return self._level[n_words][:, rows]


def _compare(left: Block, right: Block, threshold: float, same: bool) -> pd.DataFrame:
    """(a, b) pairs of a tile whose bitmaps allow the threshold."""
    slack = (1 - threshold) / (1 + threshold)
    ls, rs = left.size, right.size
    out_a, out_b = [], []
    # Buffers that stay in a core's cache; sums of many words need more than a byte.
    xor, ones, sums = np.empty((ROWS, COLUMNS), np.uint64), np.empty((ROWS, COLUMNS), np.uint8), (np.empty((ROWS, COLUMNS), np.uint8), np.empty((ROWS, COLUMNS), np.uint32))
    for j in range(0, len(rs), COLUMNS):
        s = slice(j, j + COLUMNS)
        low, high = rs[s][0], rs[s][-1]
        for i in range(0, len(ls), ROWS):
            t = slice(i, i + ROWS)
            if ls[t][0] * threshold > high + 1e-9 or ls[t][-1] < low * threshold - 1e-9 or (same and i + ROWS <= j):
                continue
            most = int(min(left.n_words[i], right.n_words[j]))
            w = min(most, bits_of(int(max(ls[t][-1], high)), FIRST_LOOK) // 64)
            lw, rw = left.folded(t, w), right.folded(s, w)
            n, m = lw.shape[1], rw.shape[1]
            few, x, c = sums[w >= 4][:n, :m], xor[:n, :m], ones[:n, :m]
            few[...] = 0
            for k in range(w):
                few += np.bitwise_count(np.bitwise_xor(lw[k, :, None], rw[k, None, :], out=x), out=c)
            hit = few <= math.floor(min((int(ls[t][-1]) + int(high)) * slack + 1e-9, 64 * w, 255 if w < 4 else 64 * w))
            if not hit.any():
                continue
            p, q = np.nonzero(hit)
            differ = few[p, q].astype(np.int64) if w == most else np.bitwise_count(left.folded(t, most)[:, p] ^ right.folded(s, most)[:, q]).sum(0, dtype=np.int64)
            keep = differ <= (ls[t][p] + rs[s][q]) * slack + 1e-9
            if same:  # both sides are in one order: each pair once
                keep &= i + p > j + q
            out_a.append(left.rep[t][p[keep]])
            out_b.append(right.rep[s][q[keep]])
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b))
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of classes (rep, size, bits) whose bitmaps allow the threshold.

    Only the number of classes per size band reaches the driver. A class is in one block, a block in the tiles of all
    blocks that its sizes can match.
    """
    ratio = math.log(1 / threshold) / BANDS
    banded = classes.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(ratio) + F.lit(1e-9)).cast("int"))
    n = {r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}
    if not n:
        return banded.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    first, last, at = {}, {}, 0
    even = min(BLOCK_MAX, max(BLOCK_MIN, math.ceil(sum(n.values()) / BLOCKS)))
    for band in sorted(n):
        each = 16 + bits_of(math.ceil(math.exp((band + 1) * ratio))) // 8
        first[band], at = at, at + math.ceil(n[band] / max(1, min(even, BLOCK_BYTES // each)))
        last[band] = at - 1
    reach = {k: (min(first[j] for j in n if abs(j - k) <= BANDS + 1), max(last[j] for j in n if abs(j - k) <= BANDS + 1)) for k in n}
    rule = F.create_map(*(x for k in n for x in (F.lit(k), F.struct(F.lit(first[k]).alias("first"), F.lit(last[k] - first[k] + 1).alias("blocks"), F.lit(reach[k][0]).alias("lo"), F.lit(reach[k][1]).alias("hi")))))
    placed = banded.withColumn("p", rule[F.col("band")])
    placed = placed.select((F.col("p.first") + F.pmod(F.xxhash64("rep"), F.col("p.blocks"))).cast("int").alias("g"), F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), "rep", "size", "bits")

    def packed(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("size")
        blobs = [t["rep"].to_numpy(np.int64).tobytes(), t["size"].to_numpy(np.int64).tobytes(), b"".join(t["bits"])]
        return pd.DataFrame([[*t[["g", "lo", "hi"]].iloc[0], *blobs]], columns=["g", "lo", "hi", "reps", "sizes", "bits"])

    def run(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        side = {g: Block(*blobs) for g, *blobs in zip(tile["g"], tile["reps"], tile["sizes"], tile["bits"])}
        i, j = key
        if i not in side or j not in side:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        return _compare(side[i], side[j], threshold, i == j)

    blocks = placed.groupBy("g").applyInPandas(packed, "g int, lo int, hi int, reps binary, sizes binary, bits binary")
    tiles = blocks.withColumn("o", F.explode(F.sequence("lo", "hi"))).select(F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "g", "reps", "sizes", "bits")
    tiles_n = sum(hi - lo + 1 for k in n for lo, hi in [reach[k]] for _ in range(last[k] - first[k] + 1)) // 2 + 1
    spread = tiles.repartition(max(1, min(20_000, tiles_n)), "i", "j")
    return spread.groupBy("i", "j").applyInPandas(run, "a long, b long")


def exact(found: DataFrame, elems: DataFrame, threshold: float) -> DataFrame:
    """(a, b, overlap, total) of the pairs (a, b) whose bags, by merging their sorted arrays, are alike enough."""
    side = lambda x: elems.select(F.col("rec").alias(x), F.col("elems").alias(f"e{x}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = b["ea"].map(len) + b["eb"].map(len)
            overlap = []
            for x, y in zip(b["ea"], b["eb"]):
                z = np.sort(np.concatenate([x, y]), kind="stable")  # merges two sorted runs
                overlap.append(int((z[1:] == z[:-1]).sum()))
            out = pd.DataFrame({"a": b["a"], "b": b["b"], "overlap": pd.Series(overlap, index=b.index, dtype="int64"), "total": total.astype("int64")})
            yield out[out["overlap"] / (out["total"] - out["overlap"]) >= threshold]

    return found.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long, overlap long, total long")


def similar_classes(df: DataFrame, row_id: str, title: str, abstract: str, threshold: float = 0.7, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, overlap, total) of class representatives alike enough, members (rec, rep, n).

    A class is all rows with an equal bag of words, its representative the smallest id; n is its number of rows.
    Rows with a null or blank title, a null abstract or fewer than `least` words in it belong to no class. Every pair
    of different bags with similarity of at least `threshold` is in pairs. Texts are read whole; ids are unique.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    made = cut(bags(df, row_id, title, abstract, least))
    classes = cut(made.groupBy("bag").agg(F.min("rec").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("bits").alias("bits")))
    members = made.select("rec", "bag").join(classes.select("bag", "rep", "n"), "bag").select("rec", "rep", "n")
    found = cut(candidates(classes.select("rep", "size", "bits"), threshold))
    needed = found.select(F.explode(F.array("a", "b")).alias(row_id)).distinct()
    again = bags(df.withColumn(row_id, F.col(row_id).cast("long")).join(needed, row_id, "left_semi"), row_id, title, abstract, least, elements=True)
    return exact(found, again.groupBy("rec").agg(F.first("elems").alias("elems")), threshold), members


def similar_pairs(df: DataFrame, row_id: str, title: str, abstract: str, threshold: float = 0.7, least: int = 30, expand: int = EXPAND) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: pairs of rows alike enough.

    Rows of a class of at most `expand` equal rows are in all their pairs. Of a larger class the representative alone
    is, and each other row of it is paired with the representative, so no link between different texts is lost.
    """
    pairs, members = similar_classes(df, row_id, title, abstract, threshold, least)
    members = cut(members)
    shown = members.where((F.col("n") <= expand) | (F.col("rec") == F.col("rep")))
    x = shown.select(F.col("rep").alias("a"), F.col("rec").alias("x"))
    y = shown.select(F.col("rep").alias("b"), F.col("rec").alias("y"))
    across = pairs.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    small = members.where((F.col("n") > 1) & (F.col("n") <= expand))
    inside = small.select("rep", F.col("rec").alias("x")).join(small.select("rep", F.col("rec").alias("y")), "rep").where("x < y").select("x", "y")
    star = members.where((F.col("n") > expand) & (F.col("rec") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("rec").alias("y"))
    return across.unionByName(inside).unionByName(star).select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return similar_pairs(spread(table(spark, sf_dir, "papers").select("rec_id", "title", "abstract"), "rec_id"), "rec_id", "title", "abstract")


def p4_groups(spark, sf_dir: str) -> DataFrame:
    """One row per record with a class: its class id and the number of other classes that are alike."""
    pairs, members = similar_classes(spread(table(spark, sf_dir, "papers").select("rec_id", "title", "abstract"), "rec_id"), "rec_id", "title", "abstract")
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(links, "rep", "left").select(F.col("rec").alias("rec_id"), F.col("rep").alias("class_id"), F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
SQL: dict[str, str] = {}
