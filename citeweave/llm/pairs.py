"""Broken prompt and response pairs.

Each row is judged alone, so the work is one scan without a shuffle. A suffix automaton of the prompt's words is
walked over the response to measure how much of it is copied; refusal automata, compiled from a grammar of denials
(see refusals), are run over each sentence; a delimiter stack and sentence ends show responses that break off;
stopwords vote on the language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.refusals import declines, idle
from citeweave.session import spread, table

# Labels and stopwords.
LEADS = [
    "based on the retrieved excerpts", "according to the sources", "according to the excerpts", "based on the sources", "here is the answer", "in short", "in summary",
    "answer", "final answer", "response", "question", "the question is", "you asked", "your question", "references", "sources", "reference", "source",
    "antwort", "frage", "die frage lautet", "kurz gesagt", "quellen", "laut den auszügen", "nach den auszügen", "hier ist die antwort", "respuesta", "pregunta", "en resumen", "fuentes",
    "según los fragmentos", "según las fuentes", "aquí está la respuesta", "réponse", "en bref", "selon les extraits", "selon les sources", "voici la réponse", "related keywords", "keywords",
]
PLACEHOLDERS = {"n a", "na", "null", "none", "nil", "nan", "undefined", "empty", "tbd", "todo", "unknown", "no answer", "keine", "ninguno", "ninguna", "aucune"}
STOPWORDS = {
    "en": "the of and a an in to is are was were be been for with on by that this these those than from as at it its our we what which how why who does do did can would if not no or whether has have without most under there all both each only their they will when where about between into".split(),
    "de": "der die das den dem des und ein eine einen einem einer ist sind war wird werden wurde wurden für mit auf von zu im am bei sich wie was welche welches warum wer nicht kein keine oder als aus auch nach über unter ohne diese dieser dieses wir unsere außerdem damit dass ob hat haben größte alle jede offen bleibt ergebnisse zeigen".split(),
    "es": "el la los las de del y un una en es son fue para con por que se lo al como qué cuál cómo cuáles quién no o si su sus este esta estos estas entre sobre sin nuestro nuestra queda abierta más han ha cada uno según cuando".split(),
    "fr": "le la les de des du et un une en est sont était pour avec par que qui se au aux ce cette ces comme quelle quel quelles quels comment pourquoi ne pas ou si son sa ses sur sans notre nous il elle dans plus ont été chaque selon face d l à entre".split(),
}
YES_NO = {"yes", "no", "ja", "nein", "sí", "si", "oui", "non"}
DANGLING = {"the", "a", "an", "of", "and", "or", "to", "in", "for", "with", "on", "by", "that", "is", "are", "der", "die", "das", "und", "von", "mit", "la", "el", "los", "de", "y", "le", "les", "et", "des", "un", "une", "una"}

COPY_SHARE, COPY_QUESTION, SHORT_WORDS = 0.72, 0.6, 6

_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[​‌‍﻿­]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_CITE = re.compile(r"\[\d+(?:\s*[,;-]\s*\d+)*\]")
_TAIL_CITES = re.compile(r"(?:[\s,;]*\[\d+(?:\s*[,;-]\s*\d+)*\])+[\s,;]*$")
_ITEM = re.compile(r"^\s*(?:[-*+•–]|\*{0,2}\d{1,3}[.)]\*{0,2})(?:\s+|$)")
_END = re.compile(r"[.!?。！？](?:[\"'”’»)\]*_`]*)$")
_SPLIT = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+")
_PAIRS = {")": "(", "]": "[", "}": "{"}


class SuffixAutomaton:
    """All substrings of a sequence, as states with links; built and walked in linear time."""

    def __init__(self, items: list[str]):
        self.next: list[dict] = [{}]
        self.link, self.len, last = [-1], [0], 0
        for x in items:
            cur = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.len.append(self.len[last] + 1)
            p = last
            while p >= 0 and x not in self.next[p]:
                self.next[p][x] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][x]
                if self.len[p] + 1 != self.len[q]:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.len.append(self.len[p] + 1)
                    while p >= 0 and self.next[p].get(x) == q:
                        self.next[p][x] = clone
                        p = self.link[p]
                    self.link[q] = clone
                    q = clone
                self.link[cur] = q
            last = cur

    def matches(self, items: list[str]) -> list[int]:
        """For each position, the length of the longest run ending there that the sequence contains."""
        out, s, n = [], 0, 0
        for x in items:
            while s and x not in self.next[s]:
                s = self.link[s]
                n = self.len[s]
            if x in self.next[s]:
                s, n = self.next[s][x], n + 1
            else:
                s, n = 0, 0
            out.append(n)
        return out


@lru_cache(maxsize=4096)
def _automaton(question: tuple[str, ...]) -> SuffixAutomaton:
    return SuffixAutomaton(list(question))


def copied(question: tuple[str, ...], answer: list[str]) -> tuple[float, float, list[int]]:
    """(share of the answer that is copied, share of the question that is repeated, positions that are not copied).

    Words in a copied run of two or more count in full, single words half.
    """
    if not question or not answer:
        return 0.0, 0.0, list(range(len(answer)))
    got = [0.0] * len(answer)
    for i, n in enumerate(_automaton(tuple(question)).matches(answer)):
        if n == 1:
            got[i] = max(got[i], 0.5)
        elif n >= 2:
            j = i
            while j > i - n and got[j] < 1.0:
                got[j] = 1.0
                j -= 1
    said = set(answer)
    return sum(got) / len(answer), sum(w in said for w in question) / len(question), [i for i, x in enumerate(got) if x == 0]


_STOP = {k: set(v) for k, v in STOPWORDS.items()}
_LANGUAGES = {w: [k for k, v in _STOP.items() if w in v] for w in set().union(*_STOP.values())}
_LEAD = re.compile(r"(?:" + "|".join(map(re.escape, sorted(LEADS, key=len, reverse=True))) + r")(?:[\s*_]*[:,.]+[\s*_]*|[\s*_]*$)", re.I)


def _votes(words: list[str]) -> dict[str, int]:
    votes = dict.fromkeys(_STOP, 0)
    for w in words:
        for k in _LANGUAGES.get(w, ()):
            votes[k] += 1
    return votes


def _unlead(s: str) -> str:
    """s without a lead-in such as `In short:` at its start."""
    t = s.lstrip(" \t*_#>\"'“”«")
    m = _LEAD.match(t)
    return t[m.end() :] if m else t


def language(words, least: int = 1) -> str | None:
    """The language with most stopwords among words, if it has `least` and more than any other."""
    (first, n), (_, m) = sorted(_votes(words).items(), key=lambda x: -x[1])[:2]
    return first if n >= least and n > m else None


@lru_cache(maxsize=4096)
def _spoken(asked: tuple[str, ...]) -> str | None:
    return language(asked)


def _cut_off(text: str) -> bool:
    """Whether text ends before its last sentence or list item does."""
    t = _TAIL_CITES.sub("", text.rstrip()).rstrip()
    stack: list[str] = []
    for ch in t:
        if ch in "([{":
            stack.append(ch)
        elif ch in _PAIRS and stack and stack[-1] == _PAIRS[ch]:
            stack.pop()
    if stack and not _END.search(t):
        return True
    if t.count("```") % 2:
        return True
    lines = [x.rstrip() for x in t.split("\n") if x.strip()]
    if not lines:
        return False
    last = lines[-1]
    if len(lines) > 1 and (not _WORD.search(_ITEM.sub("", last)) or re.match(r"^\s*#+\s*$", last)):
        return True
    if re.match(r"^\s*\d{1,3}[.)]\s*$", last):
        return True
    if re.search(r"(?:\.\.\.|…)[\"'”’»)\]*_`]*$", last):
        return True
    if _END.search(last):
        return False
    if last.endswith(":"):
        return True
    m = _ITEM.match(last)
    if m and len(lines) > 1:
        before = lines[-2]
        if before.endswith(":") or (_ITEM.match(before) and not _END.search(_TAIL_CITES.sub("", before).rstrip())):
            return len(_WORD.findall(last)) > 8
    if "|" in last and last.count("|") >= 2:
        return False
    whole = _WORD.findall(_unlead(t))
    if len(lines) == 1 and len(whole) <= SHORT_WORDS and not re.search(r"[.!?]\s", _unlead(t)):
        return whole[-1].lower() in DANGLING if whole else False
    return True


def judge(question: str | None, answer: str | None, should_refuse: bool | None) -> str | None:
    """The defect of one pair (empty, copy, refusal, truncated or language), or None.

    A null question is an empty one. A refusal is a defect only where should_refuse is false, not where it is null.
    """
    text = _TAG.sub(" ", _HIDDEN.sub("", answer or ""))
    text = text.replace("’", "'")
    bare = _CITE.sub(" ", text)
    segments = []
    for line in bare.split("\n"):
        line = re.sub(r"^\s*(?:#+|>+)\s*", "", line)
        line = _ITEM.sub("", line)
        for s in _SPLIT.split(line):
            s = _unlead(s.strip())
            found = _WORD.findall(s.lower())
            if found:
                segments.append((s, found))
    words = [w for _, found in segments for w in found]
    if not words or " ".join(words) in PLACEHOLDERS:
        return "empty"

    asked = tuple(w.lower() for w in _WORD.findall(question or ""))
    new, said = set(asked), set(words)
    repeats = asked and sum(w in said for w in asked) / len(asked) >= COPY_QUESTION
    if repeats and sum(w not in new for w in words) <= max(1, 0.2 * len(words)):  # else no walk could find a copy
        share, _, rest = copied(asked, words)
        runs, longest = 0, 0
        for k, i in enumerate(rest):
            runs = runs + 1 if k and rest[k - 1] == i - 1 else 1
            longest = max(longest, runs)
        says = any(words[i] in YES_NO or words[i].isdigit() for i in rest)
        if share >= COPY_SHARE and longest <= 1 and len(rest) <= max(1, 0.2 * len(words)) and not says:
            return "copy"

    declined, substance = False, []
    for s, found in segments:
        if declines(s, found):
            declined = True
        elif not repeats or copied(asked, found)[0] < 0.9:
            substance.append((s, found))
    if declined and all(idle(s) for s, _ in substance):
        return "refusal" if should_refuse is False else None

    if _cut_off(text):
        return "truncated"

    mine = _spoken(asked)
    said = [w for _, found in substance for w in found]
    theirs = language(said, 2)
    if mine and theirs and mine != theirs:
        votes = _votes(said)
        if votes[theirs] >= 2 * max(1, votes[mine]) or votes[theirs] - votes[mine] >= 5:
            return "language"
    return None


def flag_pairs(df: DataFrame, row_id: str, question: str, answer: str, should_refuse: str) -> DataFrame:
    """(row_id, defect) of each row of df that holds a defective pair.

    Nulls are taken as judge() says; repeated rows are judged each; whole texts are read, whatever their length; an
    empty table gives no rows; other columns are not read.
    """
    kind = dict(df.dtypes)[row_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [judge(*(None if pd.isna(x) else x for x in row)) for row in zip(b["q"], b["a"], b["r"])]
            out = pd.DataFrame({row_id: b["i"], "defect": pd.Series(found, index=b.index, dtype=object)})
            yield out[out["defect"].notna()]

    cols = df.select(F.col(row_id).alias("i"), F.col(question).alias("q"), F.col(answer).alias("a"), F.col(should_refuse).cast("string").alias("r"))
    cols = cols.withColumn("r", F.col("r").cast("boolean"))
    return cols.mapInPandas(run, f"`{row_id}` {kind}, defect string")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return flag_pairs(spread(table(spark, sf_dir, "d_oos_full_answers").select("qa_id", "question", "answer_full", "should_refuse"), "qa_id"), "qa_id", "question", "answer_full", "should_refuse")


def p2_by_kind(spark, sf_dir: str) -> DataFrame:
    """Pairs and defects per kind of question."""
    df = table(spark, sf_dir, "d_oos_full_answers")
    bad = flag_pairs(df, "qa_id", "question", "answer_full", "should_refuse")
    both = df.select("qa_id", "kind").join(bad, "qa_id", "left")
    return both.groupBy("kind", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n"))


QUERIES = {"p2_found": p2_found, "p2_by_kind": p2_by_kind}
SQL: dict[str, str] = {}
