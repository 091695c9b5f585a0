"""Identifier columns: paper keys, arXiv ids, DOIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks that may surround a key, and the shapes of arXiv and DOI identifiers.
BLANK = r"[\s ​﻿]"
ARXIV_NEW = r"\d{4}\.\d{4,5}"
ARXIV_OLD = r"[a-z\-]+(?:\.[a-z]{2})?/\d{7}"
DOI = r"^10\.[0-9]{4,9}/\S+$"

_BLANKS = " \t\n\x0b\f\r\u00a0\u200b\ufeff"
_ARXIV = rf"(?i)^(?:https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/)?({ARXIV_NEW}|{ARXIV_OLD})(?:v\d+)?(?:\.pdf)?$"


def stripped(c: Column) -> Column:
    """c without outer blanks, null where nothing is left."""
    s = F.btrim(c, F.lit(_BLANKS))
    return F.when(s != "", s)


def arxiv_id(c: Column) -> Column:
    """The arXiv id held by c (bare, arXiv: prefix or URL) without version, old-style ids in lower case; else null."""
    s = F.regexp_replace(stripped(c), r"(?i)^arxiv:\s*", "")
    return F.when(s.rlike(_ARXIV), F.lower(F.regexp_extract(s, _ARXIV, 1)))


def split_key(df: DataFrame, key: str, scheme: str = "scheme", ident: str = "ident") -> DataFrame:
    """df with (scheme, ident) of the paper key in column `key`, in place of that column.

    Scheme in lower case; an arXiv number, bare or as a URL, has scheme arxiv and no version; identifiers of schemes
    arxiv and doi are in lower case. A key with no scheme has a null scheme, one with nothing after the colon a null
    identifier, a blank or null key both. The steps are projections of their own and end in a generator, which later
    filters are not pushed through, so that each step is computed once; only keys that may be arXiv's are matched
    against a pattern.
    """
    one = df.withColumn("_s", F.btrim(F.col(key), F.lit(_BLANKS)))
    two = one.withColumn("_c", F.instr("_s", ":"))
    three = two.withColumns({
        "_scheme": F.when(F.col("_c") > 0, F.lower(F.trim(F.substring_index("_s", ":", 1)))),
        "_ident": F.when(F.col("_c") > 0, F.col("_s").substr(F.col("_c") + 1, F.length("_s"))).otherwise(F.col("_s")),
    })
    bare = F.col("_scheme").isNull() | F.col("_scheme").isin("http", "https")
    found = F.when(F.col("_scheme") == "arxiv", F.regexp_extract(F.trim("_ident"), _ARXIV, 1)).when(bare, F.regexp_extract("_s", _ARXIV, 1)).otherwise(F.lit(""))
    four = three.withColumn("_arxiv", found)
    is_arxiv = F.col("_arxiv") != ""
    low = F.when(is_arxiv, F.lower("_arxiv")).when(F.col("_scheme").isin("doi", "arxiv"), F.lower("_ident")).otherwise(F.col("_ident"))
    five = four.withColumns({"_ident": low, "_scheme": F.when(is_arxiv, F.lit("arxiv")).otherwise(F.col("_scheme"))})
    both = F.struct(F.when(F.col("_scheme") != "", F.col("_scheme")).alias("s"), F.when(F.col("_ident") != "", F.col("_ident")).alias("i"))
    kept = [c for c in df.columns if c != key]
    out = five.select(*kept, F.explode(F.array(both)).alias("_key"))  # filters on the parts stay above the generator
    return out.select(*kept, F.col("_key.s").alias(scheme), F.col("_key.i").alias(ident))


def key_text(scheme: Column, ident: Column) -> Column:
    """One text that is equal for equal paper keys; null for a blank key."""
    return F.when(scheme.isNotNull() | ident.isNotNull(), F.concat(F.coalesce(scheme, F.lit("")), F.lit(":"), F.coalesce(ident, F.lit(""))))


def doi_key(c: Column) -> Column:
    """A well-formed DOI without outer blanks, case and leading doi:, else null."""
    s = F.regexp_replace(F.lower(stripped(c)), rf"^doi:{BLANK}*", "")
    return F.when(s.rlike(DOI), s)
