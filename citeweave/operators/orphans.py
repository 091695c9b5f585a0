"""References to records that do not exist.

A reference is a tuple of key columns. References are grouped by their null mask (which columns are null); each mask
is anti-joined on its non-null columns, and what that means is declared by `match`:

simple   a reference with any null refers to nothing and is never an orphan
full     all null refers to nothing; some null is always an orphan; none null must be found
partial  all null refers to nothing; else some parent must agree on the non-null columns
exact    all null refers to nothing; else some parent with the same mask must agree on the non-null columns
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.ids import split_key
from citeweave.functions.skew import lookup
from citeweave.session import table

MATCHES = ("simple", "full", "partial", "exact")


def null_mask(cols: list[str]) -> Column:
    """Bit i is set where column i is null."""
    mask = F.lit(0)
    for i, c in enumerate(cols):
        mask = mask.bitwiseOR(F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)))
    return mask


def find_orphans(
    refs: DataFrame,
    parents: DataFrame,
    keys: list[str],
    row_id: str,
    match: str = "simple",
    seen_at: str | None = None,
    born_at: str | None = None,
    deleted_at: str | None = None,
) -> DataFrame:
    """The rows of refs whose key is an orphan, with a column `reason`.

    keys are named alike in both inputs. reason is `missing` if no parent matches, else `deleted` if each matching
    parent has a deleted_at, else `late` if the earliest born_at of the matching parents is after the reference's
    seen_at (never if either is null). Null keys follow `match`; repeated references are reported each, repeated
    parents count once, empty inputs give no parents or no rows; other columns of refs are kept, those of parents
    are not looked at.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    clash = {"reason", "_mask", "_salt", "_n", "_live", "_born"} & set(refs.columns)
    if clash:
        raise ValueError(f"rename these columns of refs first: {sorted(clash)}")
    k = [f"_k{i}" for i in range(len(keys))]
    none, every = 0, (1 << len(keys)) - 1
    state = parents.select(
        *(F.col(c).alias(n) for c, n in zip(keys, k)),
        null_mask(keys).alias("_mask"),
        (F.lit(1) if deleted_at is None else F.when(F.col(deleted_at).isNull(), 1).otherwise(0)).alias("_live"),
        (F.lit(None).cast("timestamp") if born_at is None else F.col(born_at)).alias("_born"),
    )
    if match == "partial":  # a parent serves each mask that leaves some of its non-null columns
        masks = F.array(*(F.lit(m) for m in range(every)))
        state = state.withColumn("_own", F.col("_mask")).withColumn("_mask", F.explode(masks))
        state = state.where(F.col("_own").bitwiseAND(F.bitwise_not(F.col("_mask"))) == 0).drop("_own")
    elif match != "exact":
        state = state.where(F.col("_mask") == none)

    def joinable(df: DataFrame) -> DataFrame:
        """Columns under the mask all get one value: only the non-null columns decide."""
        return df.select(
            *(x for x in df.columns if x not in k),
            *(F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) == 0, F.col(c).cast("string")).otherwise(F.lit("")).alias(c) for i, c in enumerate(k)),
        )

    state = joinable(state).groupBy("_mask", *k).agg(F.count("*").alias("_n"), F.max("_live").alias("_live"), F.min("_born").alias("_born"))
    asked = refs.withColumns({n: F.col(c) for c, n in zip(keys, k)} | {"_mask": null_mask(keys)})
    asked = asked.where(F.col("_mask") == none) if match == "simple" else asked.where(F.col("_mask") != every)
    found = lookup(joinable(asked), state, ["_mask", *k], F.col(row_id))
    late = F.lit(False) if seen_at is None else F.coalesce(F.col("_born") > F.col(seen_at), F.lit(False))
    reason = F.when(F.col("_n").isNull(), "missing").when(F.col("_live") == 0, "deleted").when(late, "late")
    return found.withColumn("reason", reason).where("reason is not null").select(*refs.columns, "reason")


def citation_references(edges: DataFrame, ref_edges: DataFrame) -> DataFrame:
    """(tbl, row_id, field, scheme, ident, fetch_date): the references of both citation tables, each table read once."""
    sides = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("key")) for c in ("citer_id", "cited_id"))))
    a = edges.select(F.lit("edges").alias("tbl"), "row_id", sides.alias("r"), "fetch_date").select("tbl", "row_id", "r.field", "r.key", "fetch_date")
    b = ref_edges.select(F.lit("ref_edges").alias("tbl"), "row_id", F.lit("ref_id").alias("field"), F.col("ref_id").alias("key"), "fetch_date")
    return split_key(a.unionByName(b), "key").select("tbl", "row_id", "field", "scheme", "ident", "fetch_date")


def citation_orphans(edges: DataFrame, ref_edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Orphans of the citation tables: (tbl, row_id, field, fetch_date, reason).

    A key is (scheme, identifier) and must match exactly: a key without a scheme is only equal to such a key.
    """
    held = split_key(papers.select("canonical_id", "ingested_at", "deleted_at"), "canonical_id").where("scheme is not null or ident is not null")
    refs = citation_references(edges, ref_edges)
    out = find_orphans(refs, held, ["scheme", "ident"], "row_id", "exact", "fetch_date", "ingested_at", "deleted_at")
    return out.select("tbl", "row_id", "field", "fetch_date", "reason")


def p1_found(spark, sf_dir: str) -> DataFrame:
    out = citation_orphans(*(table(spark, sf_dir, t) for t in ("edges", "ref_edges", "papers")))
    return out.select("tbl", "row_id", "field", "reason")


def p1_by_month(spark, sf_dir: str) -> DataFrame:
    """Orphans per table, field and month of fetch_date (null where that is null)."""
    out = citation_orphans(*(table(spark, sf_dir, t) for t in ("edges", "ref_edges", "papers")))
    return out.groupBy("tbl", "field", F.date_format("fetch_date", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n"))


_KEYED = r"""
  CASE WHEN regexp_matches(s, '^(?:https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/)?(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?$', 'i')
       THEN 'arxiv:' || lower(regexp_extract(s, '(?i)(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})(?:v\d+)?(?:\.pdf)?$', 1))
       WHEN regexp_matches(s, '^arxiv:(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})(v\d+)?$', 'i')
       THEN 'arxiv:' || lower(regexp_extract(s, '(?i)^arxiv:(\d{4}\.\d{4,5}|[a-z\-]+(?:\.[a-z]{2})?/\d{7})', 1))
       WHEN lower(s[:4]) = 'doi:' THEN lower(s)
       WHEN instr(s, ':') > 0 THEN lower(trim(s[:instr(s, ':') - 1])) || s[instr(s, ':'):]
       ELSE ':' || s END"""
_ORPHANS = (
    r"""WITH refs AS (
  SELECT 'edges' AS tbl, row_id, 'citer_id' AS field, citer_id AS k, fetch_date FROM edges
  UNION ALL SELECT 'edges', row_id, 'cited_id', cited_id, fetch_date FROM edges
  UNION ALL SELECT 'ref_edges', row_id, 'ref_id', ref_id, fetch_date FROM ref_edges),
r AS (SELECT tbl, row_id, field, fetch_date, regexp_replace(k, '^[\s\x{00a0}\x{200b}\x{feff}]+|[\s\x{00a0}\x{200b}\x{feff}]+$', '', 'g') AS s FROM refs),
p AS (SELECT regexp_replace(canonical_id, '^[\s\x{00a0}\x{200b}\x{feff}]+|[\s\x{00a0}\x{200b}\x{feff}]+$', '', 'g') AS s, ingested_at, deleted_at FROM papers),
pk AS (SELECT """
    + _KEYED
    + """ AS k, min(ingested_at) AS born, bool_and(deleted_at IS NOT NULL) AS gone FROM p WHERE s <> '' GROUP BY 1),
o AS (SELECT tbl, row_id, field, fetch_date, CASE WHEN pk.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN born > fetch_date THEN 'late' END AS reason
  FROM (SELECT *, """
    + _KEYED
    + """ AS k FROM r WHERE s <> '') x LEFT JOIN pk ON pk.k = x.k)
"""
)

QUERIES = {"p1_found": p1_found, "p1_by_month": p1_by_month}
SQL = {
    "p1_found": _ORPHANS + "SELECT tbl, row_id, field, reason FROM o WHERE reason IS NOT NULL",
    "p1_by_month": _ORPHANS + "SELECT tbl, field, strftime(fetch_date AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS n FROM o WHERE reason IS NOT NULL GROUP BY ALL",
}
