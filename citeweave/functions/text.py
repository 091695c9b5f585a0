"""Text columns: tokens, titles, rules over phrases. All are built-in expressions; null in, null out unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase lists and patterns whose results must match.
BAD_TITLES = ["published as a conference", "arXiv:", "abstract$", "untitled$"]
NOISE = [
    r"\bprotein structure\b", r"\balphafold\b", r"\bath erosclerosis\b", r"\baflatoxin\b", r"\bsulfonamide\b", r"\bbioconcentration\b", r"\bnitrification\b", r"\bchloroP\b",
    r"\bchloroplast\b", r"\bemt,\s*cscs\b", r"\bdrug resistance\b", r"\bclinical implications\b", r"\bmedical report generation\b", r"\bwildfire\b", r"\bcar-following\b", r"\bcryptocurrency portfolio\b",
]
TOPIC_KEYWORDS = [
    r"mechanistic interpretab", r"circuit discovery", r"sparse autoencoder", r"interpretab.*transformer", r"interpretab.*language model", r"interpretab.*llm", r"statistical mechanics of learning",
    r"statistical mechanics.*neural", r"statistical mechanics.*deep learning", r"random matrix.*neural", r"random matrix.*deep learning", r"loss surface", r"loss landscape", r"neural tangent", r"grokking",
    r"feature learning", r"implicit regularization", r"hessian.*neural", r"spectrum.*neural network", r"marchenko.?pastur",
]
SEED_TOPICS = ["mechanistic interpretability", "statistical mechanics of learning", "random matrix theory neural networks"]
REFUSALS = ["not covered", "do not contain", "does not provide", "no relevant", "not enough information", "ingested papers do not", "cannot answer", "outside the scope", "not present in", "i don't know", "i do not know", "unable to answer"]
REFUSALS_BROADER = [*REFUSALS, "there is no information", "no mention", "insufficient context", "insufficient evidence", "insufficient information", "excerpts do not", "not in the ingested"]
INTENTS = [
    ("LIMITATIONS_FUTURE", ["limitation", "weakness", "failure", "bottleneck", "future work", "drawback"]),
    ("EMPIRICAL_EVAL", ["dataset", "benchmark", "accuracy", "baseline", "experiment", "metric", "hyperparameter", "results", "empirical"]),
    ("THEORETICAL_TECH", ["proof", "theorem", "lemma", "formula", "derivation", "convergence", "bound"]),
    ("CONTRIBUTION_SUMMARY", ["contribution", "overview", "summary", "propose", "introduce", "main idea", "novel", "what is", "explain"]),
]
BOOSTS = [
    ("CONTRIBUTION_SUMMARY", 0.015, ["abstract", "introduction", "conclusion", "overview", "contribution"]),
    ("LIMITATIONS_FUTURE", 0.020, ["limitation", "discussion", "future work", "conclusion"]),
    ("EMPIRICAL_EVAL", 0.020, ["experiment", "result", "evaluation", "benchmark", "dataset", "ablation"]),
    ("THEORETICAL_TECH", 0.015, ["method", "architecture", "model", "proof", "theory", "formulation"]),
]


def has_any(c: Column, phrases: list[str]) -> Column:
    """Whether c contains one of the phrases, literally."""
    return reduce(lambda a, b: a | b, (c.contains(p) for p in phrases))


# A run of letters, digits, `_`, `.` and `-` that is ASCII once outer `.` and `-` are off, two characters at least.
_TOKEN = r"(?<![\p{L}\p{N}_.\-])[.\-]*([a-z0-9_][a-z0-9_.\-]*[a-z0-9_])[.\-]*(?![\p{L}\p{N}_.\-])"


def tokens(c: Column) -> Column:
    """Lower-case tokens of letters, digits, `_`, `.` and `-` longer than one character, in order, with repeats."""
    return F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), 1)


def title_tokens(c: Column) -> Column:
    """Distinct lower-case alphanumeric tokens longer than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0), lambda x: F.length(x) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the size of the larger array; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def plain_title(c: Column) -> Column:
    """Lower case, everything but ASCII letters and digits a single blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def plain_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain_title(c), " "), lambda x: x != ""))


def clean_text(c: Column) -> Column:
    """Blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_doi(c: Column) -> Column:
    s = F.trim(F.replace(c, F.lit("https://doi.org/"), F.lit("")))
    return F.when(s != "", s)


def bad_title(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(t) < 8) | t.rlike("(?i)^(" + "|".join(BAD_TITLES) + ")")


def noisy(title: Column, abstract: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))).rlike("(?i)" + "|".join(NOISE))


def topic_relevance(*texts: Column) -> Column:
    """Matches of topic patterns plus twice those of seed topics, over four, at most 1."""
    blob = F.lower(F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts)))
    hits = sum((blob.rlike(p).cast("int") for p in TOPIC_KEYWORDS), F.lit(0)) + sum((2 * blob.contains(s).cast("int") for s in SEED_TOPICS), F.lit(0))
    return F.least(hits / 4.0, F.lit(1.0))


def intent(c: Column) -> Column:
    """The first intent one of whose keywords the query contains, else GENERAL."""
    low, out = F.lower(c), F.lit("GENERAL")
    for name, keys in reversed(INTENTS):
        out = F.when(has_any(low, keys), F.lit(name)).otherwise(out)
    return out


def section_boost(section: Column, wanted: Column) -> Column:
    """What a section named so adds to a passage's score under the intent; 0 for a null section."""
    low, out = F.lower(section), F.lit(0.0)
    for name, boost, keys in BOOSTS:
        out = F.when((wanted == name) & has_any(low, keys), F.lit(boost)).otherwise(out)
    return out


def refuses(answer: Column, broader: bool = False) -> Column:
    """Whether the answer holds a refusal phrase; a null answer does not."""
    return has_any(F.lower(F.coalesce(answer, F.lit(""))), REFUSALS_BROADER if broader else REFUSALS)


def cited_numbers(answer: Column) -> Column:
    """The n of each [n] in the answer, as ints."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))


def citations_valid(answer: Column, n_sources: Column) -> Column:
    """All [n] lie in 1..n_sources; an answer without any is valid if there are no sources or it refuses."""
    n = F.coalesce(n_sources, F.lit(0))
    cited = cited_numbers(answer)
    return F.when(F.size(cited) > 0, F.forall(cited, lambda x: (x >= 1) & (x <= n))).otherwise((n == 0) | refuses(answer))


def coverage(score: Column) -> Column:
    """none without a score, low below .55, partial below .70, else high."""
    return F.when(score.isNull(), "none").when(score < 0.55, "low").when(score < 0.70, "partial").otherwise("high")


def any_sql(col: str, phrases: list[str]) -> str:
    """DuckDB: whether col contains one of the phrases."""
    return "(" + " OR ".join(f"contains({col}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


TOKENS_SQL = r"list_filter(list_transform(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_.\-]+'), lambda x: lower(regexp_replace(x, '^[.\-]+|[.\-]+$', '', 'g'))), lambda x: regexp_full_match(x, '[A-Za-z0-9_.\-]{{2,}}'))"
TITLE_TOKENS_SQL = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda x: length(x) > 2))"
