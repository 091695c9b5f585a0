"""Filling fixed-capacity containers with items.

Best-fit decreasing is planned over the histogram of lengths, not over items: the histogram has at most `capacity`
entries, so the plan does not grow with the data. Items then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.tokens import VOCABULARY, token_counts
from citeweave.session import cut, spread, table

#: Rows of one length that are ranked in one task, about: a length has as many parts as its count asks for, so that a
#: common length (most pieces of cut documents are as long as the container) is no hot task at any size.
RANK_ROWS = 100_000


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: ([(length, first rank, items, first bin, items per bin)], number of bins).

    Bins are kept as runs of equal free space. An item goes to the least free space it fits in, so a bin of free
    space r takes floor(r / length) items before the next bin is touched; a run is filled or split at once.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    free: list[int] = []
    rows, bins = [], 0

    def put(space: int, start: int, n: int) -> None:
        if n and space:
            if space not in runs:
                runs[space] = []
                insort(free, space)
            runs[space].append((start, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError("lengths must be above 0 and at most the capacity")
        while left:
            i = bisect_left(free, length)
            if i < len(free):
                space = free[i]
                start, n = runs[space].pop()
                if not runs[space]:
                    del runs[space]
                    free.pop(i)
            else:
                space, start, n = capacity, bins, math.ceil(left / (capacity // length))
                bins += n
            per = space // length
            full = min(n, left // per)
            if full:
                rows.append((length, rank, full * per, start, per))
                put(space - per * length, start, full)
                rank, left, start, n = rank + full * per, left - full * per, start + full, n - full
            if n and left and left < per:
                rows.append((length, rank, left, start, left))
                put(space - left * length, start, 1)
                rank, left, start, n = rank + left, 0, start + 1, n - 1
            put(space, start, n)
    return rows, bins


def pieces(sized: DataFrame, capacity: DataFrame) -> DataFrame:
    """(container, doc_id, piece, first_token, len): documents cut only where longer than the container.

    A document of t tokens gives floor(t / capacity) full pieces and the rest; documents without tokens give none.
    """
    each = sized.where("tokens > 0").crossJoin(F.broadcast(capacity))  # three rows: the containers
    n = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    each = each.withColumn("piece", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    first = F.col("piece").cast("long") * F.col("capacity_tokens")
    return each.select("container", "capacity_tokens", "doc_id", "piece", first.alias("first_token"), F.least(F.col("capacity_tokens").cast("long"), F.col("tokens") - first).cast("int").alias("len"))


def pack(sized: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, bin, doc_id, piece, first_token, tokens): the bin of each piece of each document.

    sized has (doc_id, tokens), containers (container, capacity_tokens). Containers without a positive capacity are
    left out, of repeated ones the largest capacity holds. Repeated doc_ids are packed each. Only the histogram of
    lengths, at most `capacity` rows per container, reaches the driver, and the plan sent back is bounded likewise.
    """
    spark = sized.sparkSession
    capacity = containers.where("container is not null and capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    items = pieces(cut(sized.select("doc_id", "tokens")), capacity)
    lengths: dict[tuple[str, int], dict[int, int]] = {}
    for r in items.groupBy("container", "capacity_tokens", "len").agg(F.count("*").alias("n")).collect():
        lengths.setdefault((r["container"], r["capacity_tokens"]), {})[r["len"]] = r["n"]
    rows = [(name, *row) for (name, cap), h in lengths.items() for row in plan_bins(h, cap)[0]]
    plan = spark.createDataFrame(rows, "container string, len int, rank0 long, items long, bin0 long, per int")
    split = spark.createDataFrame([(name, k, math.ceil(n / RANK_ROWS)) for (name, _), h in lengths.items() for k, n in h.items()], "container string, len int, parts int")
    items = items.join(F.broadcast(split), ["container", "len"])  # a row per length, bounded by the capacities
    items = items.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("int"))
    counts = items.groupBy("container", "len", "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("container", "len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("container", "len", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("container", "len", "_part").orderBy("doc_id", "piece")) - 1
    ranked = items.withColumn("_within", within).join(offsets, ["container", "len", "_part"]).withColumn("_rank", F.col("_before") + F.col("_within"))
    slot = (ranked["container"] == plan["container"]) & (ranked["len"] == plan["len"]) & (F.col("_rank") >= F.col("rank0")) & (F.col("_rank") < F.col("rank0") + F.col("items"))
    placed = ranked.join(F.broadcast(plan), slot)  # bounded by the capacities
    bin_ = F.col("bin0") + F.floor((F.col("_rank") - F.col("rank0")) / F.col("per")).cast("long")
    return placed.select(ranked["container"], bin_.alias("bin"), "doc_id", "piece", "first_token", ranked["len"].cast("long").alias("tokens"))


def _packed(spark, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    sized = token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "text", ["doc_id"], path)
    return pack(sized, table(spark, sf_dir, "container_sizes"))


def p6_packing(spark, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p6_space(spark, sf_dir: str) -> DataFrame:
    """Per container: bins, tokens placed, tokens of space left unused and its share."""
    used = _packed(spark, sf_dir).groupBy("container").agg((F.max("bin") + 1).alias("bins"), F.sum("tokens").alias("tokens"))
    out = used.join(table(spark, sf_dir, "container_sizes"), "container")
    space = F.col("bins") * F.col("capacity_tokens")
    return out.select("container", "bins", "tokens", (space - F.col("tokens")).alias("unused"), F.round(1 - F.col("tokens") / space, 6).alias("unused_share"))


QUERIES = {"p6_packing": p6_packing, "p6_space": p6_space}
SQL: dict[str, str] = {}
