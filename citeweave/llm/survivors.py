"""Best representative of each duplicate group.

Records of one work are found by connected components over shared keys. Their fields are unpivoted to long rows, and
each usable value gets a vote from its record: source trust times recency decay. Votes are summed per normalised value
of a field, the winner of each field is chosen by max_by, and the winners are pivoted back to one record per work.

Votes are cast on levels. Sums of one level are compared before those of the next, so no number of votes on lower
levels outweighs one on a higher level: that is a trust and a decay so steep that they could not be written as numbers.
Which level a record votes on is a rule of the field: `first` has one level for each trust rank and time, in the order
in which the field prefers them, `sum` a single one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions.ids import BLANK, doi_key, key_text, split_key
from citeweave.functions.skew import lookup
from citeweave.operators.components import connected_components
from citeweave.session import table

#: Snapshot of the catalog, epoch seconds (2026-07-01 UTC): later update times are impossible.
SNAPSHOT = 1_782_864_000.0
#: Days in which a vote loses half of its weight.
HALF_LIFE_DAYS = 365.0
TRUST_FIRST = ("doi", "source")


def same_work(papers: DataFrame) -> DataFrame:
    """(rec_id, group_id) of the records that share a work with another record.

    Linked are records with an equal canonical_id or equal well-formed DOI (column doi, or identifier of a doi key),
    directly or through others; group_id is the smallest rec_id. Null and blank ids and malformed DOIs link nothing.
    """
    keyed = split_key(papers.select("rec_id", "canonical_id", F.concat(F.lit("doi:"), doi_key(F.col("doi"))).alias("_d")), "canonical_id")
    keys = F.array_distinct(F.array_compact(F.array(key_text(F.col("scheme"), F.col("ident")), F.col("_d"))))
    held = keyed.select("rec_id", F.explode(keys).alias("key"))
    low = held.groupBy("key").agg(F.min("rec_id").alias("low"))
    edges = lookup(held, low, ["key"], F.col("rec_id"), "inner").where("rec_id != low").select("rec_id", "low")
    return connected_components(edges).select(F.col("id").alias("rec_id"), F.col("component").alias("group_id"))


def source_key(c):
    return F.lower(F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", ""))


def field_votes(papers: DataFrame, trust: DataFrame, groups: DataFrame, snapshot: float = SNAPSHOT) -> DataFrame:
    """Long rows (group_id, field, value, rec_id, rank, seen): each usable value of each record in a group.

    value is normalised text; rank is the trust rank of the record's source, null if that is unusable; seen is its
    update time, null if unusable (null, not a number, not above 0 or after the snapshot).
    """
    ranks = trust.select(source_key(F.col("source")).alias("_src"), "trust_rank").where("_src != ''").groupBy("_src").agg(F.min("trust_rank").alias("rank"))
    own = papers.select("rec_id", "doi", "citation_count", source_key(F.col("source")).alias("_src"), "updated_at")
    own = own.join(groups, "rec_id").join(ranks, "_src", "left")
    seen = F.when((F.col("updated_at") > 0) & (F.col("updated_at") <= snapshot) & ~F.isnan("updated_at"), F.col("updated_at"))
    own = own.select(
        "group_id", "rec_id", "rank", seen.alias("seen"), doi_key(F.col("doi")).alias("doi"),
        F.when(F.col("citation_count") >= 0, F.col("citation_count")).cast("string").alias("citation_count"),
        F.when(F.col("rank").isNotNull(), F.col("_src")).alias("source"), seen.cast("string").alias("updated_at"),
    )
    return own.unpivot(["group_id", "rec_id", "rank", "seen"], ["doi", "citation_count", "source", "updated_at"], "field", "value").where("value is not null")


def level(field, rank, seen):
    """`first`: the level of a vote, by trust then time for doi and source, time then trust for citation_count, time for updated_at.

    An unusable source and an unusable time are the lowest.
    """
    trust, time = F.coalesce(-rank, F.lit(-(2**31))).cast("double"), F.coalesce(seen, F.lit(-1.0))
    trusted = field.isin(*TRUST_FIRST)
    return F.struct(F.when(trusted, trust).otherwise(time).alias("first"), F.when(trusted, time).when(field == "updated_at", F.lit(0.0)).otherwise(trust).alias("then"))


def flat(field, rank, seen):
    """`sum`: every vote is on one level."""
    return F.struct(F.lit(0.0).alias("first"), F.lit(0.0).alias("then"))


def vote(rank, seen, snapshot: float = SNAPSHOT):
    """1 / trust rank (0.05 for an unusable source) times a decay that halves in HALF_LIFE_DAYS (0.01 for an unusable time)."""
    age = (F.lit(snapshot) - seen) / 86_400.0
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.05)) * F.coalesce(F.pow(F.lit(0.5), age / HALF_LIFE_DAYS), F.lit(0.01))


#: How votes are put on levels, and whether sums decide between values whose highest levels are equal before the
#: smallest rec_id does.
WAYS = {"first": (level, False), "sum": (flat, True)}


def winners(votes: DataFrame, way: str = "first", snapshot: float = SNAPSHOT) -> DataFrame:
    """(group_id, field, value, rec_id, votes): the winning value of each field, the record that supplies it, its votes.

    votes is the sum on the value's highest level; rec_id is, of the records that voted for the value there, the most
    trusted, then latest, then smallest id. Aggregation is partial before each shuffle, so a work that holds a third
    of all records is no hot task. No votes give no rows.
    """
    if way not in WAYS:
        raise ValueError("way must be first or sum")
    on, by_sum = WAYS[way]
    rank, seen, low = F.col("rank"), F.col("seen"), -F.col("rec_id")
    best = F.struct(F.coalesce(-rank, F.lit(-(2**31))), F.coalesce(seen, F.lit(-1.0)), low)
    ballot = votes.select("group_id", "field", "value", "rec_id", on(F.col("field"), rank, seen).alias("level"), vote(rank, seen, snapshot).alias("vote"), best.alias("best"))
    summed = ballot.groupBy("group_id", "field", "value", "level").agg(F.round(F.sum("vote"), 9).alias("votes"), F.max_by("rec_id", "best").alias("rec_id"))
    order = F.struct("level", "votes", low) if by_sum else F.struct("level", low, "votes")
    won = summed.groupBy("group_id", "field").agg(F.max_by(F.struct("value", "rec_id", "votes"), order).alias("w"))
    return won.select("group_id", "field", "w.value", "w.rec_id", "w.votes")


def merged(won: DataFrame) -> DataFrame:
    """One row per work: the winning values pivoted back to columns, null where no record has a usable one."""
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    return won.groupBy("group_id").agg(
        value("doi").alias("doi"), value("citation_count").cast("int").alias("citation_count"), value("source").alias("source"), value("updated_at").cast("double").alias("updated_at")
    )


def _votes(spark, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers")
    return field_votes(papers, table(spark, sf_dir, "source_trust"), same_work(papers))


def p3_found(spark, sf_dir: str) -> DataFrame:
    return winners(_votes(spark, sf_dir)).select("group_id", "field", "rec_id")


def p3_merged(spark, sf_dir: str) -> DataFrame:
    return merged(winners(_votes(spark, sf_dir)))


def p3_summed_votes(spark, sf_dir: str) -> DataFrame:
    """The winners where all votes are on one level: how often they differ from p3_found is in the README."""
    return winners(_votes(spark, sf_dir), "sum").select("group_id", "field", "rec_id", F.round("votes", 6).alias("votes"))


_BLANKS = r"'^[\s\x{00a0}\x{200b}\x{feff}]+|[\s\x{00a0}\x{200b}\x{feff}]+$'"
_SQL = rf"""WITH RECURSIVE s AS (
  SELECT rec_id, regexp_replace(canonical_id, {_BLANKS}, '', 'g') AS c, regexp_replace(regexp_replace(lower(doi), {_BLANKS}, '', 'g'), '^doi:\s*', '') AS d,
    citation_count, lower(regexp_replace(source, {_BLANKS}, '', 'g')) AS src,
    CASE WHEN updated_at > 0 AND updated_at <= 1782864000 THEN updated_at END AS seen FROM papers),
t AS (SELECT *, CASE WHEN regexp_matches(c, '^(arxiv:)?\d{{4}}\.\d{{4,5}}(v\d+)?$', 'i') THEN 'arxiv:' || regexp_extract(c, '\d{{4}}\.\d{{4,5}}')
    WHEN lower(c[:4]) = 'doi:' THEN lower(c) WHEN instr(c, ':') > 0 THEN lower(c[:instr(c, ':') - 1]) || c[instr(c, ':'):] WHEN c <> '' THEN ':' || c END AS ck,
    CASE WHEN regexp_matches(d, '^10\.[0-9]{{4,9}}/\S+$') THEN d END AS dk FROM s),
k AS (SELECT rec_id, ck AS key FROM t WHERE ck IS NOT NULL UNION SELECT rec_id, 'doi:' || dk FROM t WHERE dk IS NOT NULL),
l AS (SELECT DISTINCT a.rec_id AS x, b.rec_id AS y FROM k a JOIN k b USING (key)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
g AS (SELECT x AS rec_id, min(y) AS group_id FROM r GROUP BY x HAVING count(*) > 1),
v AS (SELECT g.group_id, t.*, (SELECT min(trust_rank) FROM source_trust z WHERE lower(trim(z.source)) = t.src) AS rank FROM t JOIN g USING (rec_id)),
f AS (SELECT group_id, 'doi' AS field, dk AS value, rec_id, coalesce(rank, 2147483648)::DOUBLE AS o1, -coalesce(seen, -1) AS o2 FROM v WHERE dk IS NOT NULL
  UNION ALL SELECT group_id, 'source', src, rec_id, coalesce(rank, 2147483648)::DOUBLE, -coalesce(seen, -1) FROM v WHERE rank IS NOT NULL
  UNION ALL SELECT group_id, 'citation_count', citation_count::VARCHAR, rec_id, -coalesce(seen, -1), coalesce(rank, 2147483648)::DOUBLE FROM v WHERE citation_count >= 0
  UNION ALL SELECT group_id, 'updated_at', seen::VARCHAR, rec_id, -seen, 0 FROM v WHERE seen IS NOT NULL)
"""
QUERIES = {"p3_found": p3_found, "p3_merged": p3_merged, "p3_summed_votes": p3_summed_votes}
SQL = {
    "p3_found": _SQL + "SELECT group_id, field, rec_id FROM f QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY o1, o2, rec_id) = 1",
    "p3_merged": _SQL
    + """, w AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY o1, o2, rec_id) = 1)
SELECT group_id, max(value) FILTER (field = 'doi') AS doi, max(value) FILTER (field = 'citation_count')::INT AS citation_count, max(value) FILTER (field = 'source') AS source,
  max(value) FILTER (field = 'updated_at')::DOUBLE AS updated_at FROM w GROUP BY group_id""",
    "p3_summed_votes": _SQL
    + f""", o AS (SELECT f.*, v.rank, v.seen, coalesce(1.0::DOUBLE / v.rank, 0.05::DOUBLE) * coalesce(pow(0.5::DOUBLE, (1782864000.0::DOUBLE - v.seen) / 86400.0::DOUBLE / {HALF_LIFE_DAYS}::DOUBLE), 0.01::DOUBLE) AS vote FROM f JOIN v USING (group_id, rec_id)),
z AS (SELECT group_id, field, value, round(sum(vote), 9) AS votes, arg_max(rec_id, (coalesce(-rank, -2147483648), coalesce(seen, -1), -rec_id)) AS rec_id FROM o GROUP BY ALL)
SELECT group_id, field, rec_id, round(votes, 6) AS votes FROM z QUALIFY row_number() OVER (PARTITION BY group_id, field ORDER BY votes DESC, rec_id) = 1""",
}
