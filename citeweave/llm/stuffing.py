"""Keyword-stuffed and link-list pages.

Text is read once, as sequences of function words and word classes, which are kept in a checkpoint (two bytes a word).
A trigram model of such sequences is trained on the prose sentences of all documents (counts are summed by Spark;
their number is bounded by the fixed alphabet, not by the data), then every segment of every document is scored under
it, a batch of documents at a time. A segment whose perplexity is abnormally high
(lists, links, tags) or abnormally low (runs of bare keywords) is not prose; a page is flagged when more than half of
its characters lie in such segments.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.pairs import STOPWORDS
from citeweave.session import cut, spread, table

# The alphabet.
CLASSES = ["<s>", "</s>", "url", "hash", "number", "lower", "Capital", "UPPER", "miXed", "repeat", ",", ".", ";", ":", "!", "?", "|", "·", "/", "(", ")", "[", "]", "#", "*", "-", "&", "=", "symbol"]
WORDS = sorted({w for words in STOPWORDS.values() for w in words} | {"how", "than", "only", "these", "under", "more", "also", "because", "although", "while", "i", "you", "they", "he", "she", "may", "must", "should", "s", "t"})
ID = {x: i for i, x in enumerate([*CLASSES, *WORDS])}
V = len(ID)
START, END, URL, HASH, NUMBER, LOWER, CAPITAL, UPPER, MIXED, REPEAT, SYMBOL = (ID[x] for x in ("<s>", "</s>", "url", "hash", "number", "lower", "Capital", "UPPER", "miXed", "repeat", "symbol"))
_FUNCTION = {w: ID[w] for w in WORDS}

#: Content words of a segment within which one that comes again counts as repeated.
WINDOW = 14
#: Bits by which a segment's mean surprise must differ at least, however uniform the prose.
LEAST = 1.0
#: Strength of the lower order in the interpolated model.
BACKOFF = 4.0

_TOKEN = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|#\w[\w-]*|[^\W\d_]+(?:['’][^\W\d_]+)?|\d[\d.,]*|[^\w\s]")
_TAG = re.compile(r"</?(?:p|section|div|h[1-6]|li|ul|ol|br|span|b|i|em|strong|article|td|tr|th|table)\b[^<>]*>", re.I)
_HEADING = re.compile(r"<h[1-6]\b[^<>]*>.*?</h[1-6]\s*>", re.I | re.S)
_HREF = re.compile(r"<a\s[^<>]*>(.*?)</a\s*>", re.I | re.S)
_HASHES = re.compile(r"\s*#{1,6}\s")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)]*\s+(?=[^\s])")


_FUNCTION_, _CONTENT, _LINK, _OTHER = range(4)
#: Tokens whose class a worker remembers, at most.
REMEMBERED = 200_000


def classified(t: str) -> tuple[int, int, str]:
    """(alphabet id, kind, lower case) of a token."""
    low = t.lower()
    if low in _FUNCTION:
        return _FUNCTION[low], _FUNCTION_, low
    if t[0].isalpha() and len(t) < 300 and "://" not in t and not low.startswith("www."):
        return LOWER if t.islower() else UPPER if t.isupper() else CAPITAL if t[1:].islower() or len(t) == 1 else MIXED, _CONTENT, low
    if t[0].isdigit():
        return NUMBER, _OTHER, low
    if len(t) > 1:
        return HASH if t[0] == "#" else URL, _LINK, low
    return ID.get(t, SYMBOL), _OTHER, low


def segments(text: str, known: dict | None = None) -> Iterator[tuple[list[int], int, bool]]:
    """(alphabet ids, characters, whether it looks like a plain prose sentence) of each sentence or line.

    Headings (markup h1 to h6, or # and a blank) belong to neither side and are left out. known remembers classes.
    """
    known = {} if known is None else known
    recent: deque[str] = deque(maxlen=WINDOW)
    text = _HEADING.sub("\n", text)
    text = _HREF.sub(lambda m: f"\nhttp://link {m.group(1)}\n", text)
    for line in _TAG.sub("\n", text).split("\n"):
        if _HASHES.match(line):
            continue
        for part in _SENTENCE.split(line):
            found = _TOKEN.findall(part)
            if not found:
                continue
            ids, functions, repeats, content, links = [], 0, 0, 0, 0
            recent.clear()
            for t in found:
                got = known.get(t)
                if got is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    got = known[t] = classified(t)
                i, kind, low = got
                if kind == _CONTENT:
                    content += 1
                    if low in recent:
                        i = REPEAT
                        repeats += 1
                    recent.append(low)
                elif kind == _FUNCTION_:
                    functions += 1
                elif kind == _LINK:
                    links += 1
                ids.append(i)
            part = part.strip()
            seed = part[-1] in ".!?" and part[0].isupper() and len(found) >= 6 and functions >= 1 and not links and repeats <= 0.2 * max(1, content)
            yield ids, len(part), seed


_READ = "ids array<smallint>, lens array<int>, chars array<int>, seeds array<boolean>"


def read(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, ids, lens, chars, seeds): the segments of each text one behind the other; none for a null text."""
    kind = dict(docs.dtypes)[row_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for b in batches:
            ids, lens, chars, seeds = [], [], [], []
            for t in b["t"]:
                all_ids, n, c, s = [], [], [], []
                for i, size, seed in segments(t, known) if isinstance(t, str) else ():
                    all_ids += i
                    n.append(len(i))
                    c.append(size)
                    s.append(seed)
                ids.append(np.array(all_ids, dtype=np.int16))
                lens.append(np.array(n, dtype=np.int32))
                chars.append(np.array(c, dtype=np.int32))
                seeds.append(np.array(s, dtype=bool))
            yield pd.DataFrame({row_id: b["i"], "ids": pd.Series(ids, index=b.index, dtype=object), "lens": pd.Series(lens, index=b.index, dtype=object), "chars": pd.Series(chars, index=b.index, dtype=object), "seeds": pd.Series(seeds, index=b.index, dtype=object)})

    return docs.select(F.col(row_id).alias("i"), F.col(text).alias("t")).mapInPandas(run, f"`{row_id}` {kind}, {_READ}")


def _flat(column: pd.Series, dtype) -> np.ndarray:
    return np.concatenate([np.asarray(x, dtype=dtype) for x in column]) if len(column) else np.empty(0, dtype)


def trigrams(ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Keys of all trigrams of the segments, each read with two starts before and an end behind it: lens + 1 of each."""
    n = len(lens)
    at = np.cumsum(lens + 3) - (lens + 3)
    x = np.full(int((lens + 3).sum()), START, dtype=np.int64)
    x[np.arange(len(ids)) + np.repeat(3 * np.arange(n) + 2, lens)] = ids
    x[at + lens + 2] = END
    keys = (x[:-2] * V + x[1:-1]) * V + x[2:] if len(x) else x
    inside = np.ones(len(x), dtype=bool)
    inside[at + lens + 1] = inside[at + lens + 2] = False
    return keys[inside[: len(keys)]]


def train(encoded: DataFrame) -> "Model":
    """A model of the prose sentences of read() texts; equal ones of a document count once. What reaches the driver is one count per trigram seen."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, lens = [], []
            for i, n, s in zip(b["ids"], b["lens"], b["seeds"]):
                n = np.asarray(n, dtype=np.int64)
                end = np.cumsum(n)
                once = {i[end[k] - n[k] : end[k]].tobytes() for k in np.flatnonzero(np.asarray(s, dtype=bool))}
                ids.append(np.frombuffer(b"".join(once), dtype=np.int16))
                lens += [len(x) // 2 for x in once]
            keys, n = np.unique(trigrams(np.concatenate(ids), np.array(lens, dtype=np.int64)) if lens else np.empty(0, np.int64), return_counts=True)
            yield pd.DataFrame({"k": keys, "n": n}, dtype="int64")

    counted = encoded.select("ids", "lens", "seeds").mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    got = counted.toPandas()  # at most V cubed rows, a fixed number
    return Model(dict(zip(got["k"], got["n"])))


class Model:
    """Interpolated trigram model; bits(keys) is the surprise of each trigram.

    Counts of trigrams are two sorted arrays of 4 bytes an entry, lower orders dense tables: 8 V^3 + 16 V^2 bytes at
    most, whatever the data.
    """

    def __init__(self, counts: dict[int, int]):
        keys, n = (np.fromiter(x, dtype=np.int64, count=len(counts)) for x in (counts.keys(), counts.values()))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        ctx3 = np.bincount(keys // V, weights=n, minlength=V * V)
        bi = np.bincount(keys % (V * V), weights=n, minlength=V * V).reshape(V, V)
        uni = np.bincount(keys % V, weights=n, minlength=V)
        ctx2 = np.bincount(keys // V % V, weights=n, minlength=V)
        uni = (uni + 0.1) / (uni.sum() + 0.1 * V)
        self.keys, self.n = keys.astype(np.int32), np.minimum(n, 2**32 - 1).astype(np.uint32)
        self.low, self.ctx3 = ((bi + BACKOFF * uni) / (ctx2 + BACKOFF)[:, None]).ravel(), ctx3
        total, b = n.sum(), self.bits(keys)
        self.mean = float((n * b).sum() / total) if total else 0.0
        self.sd = float(np.sqrt((n * (b - self.mean) ** 2).sum() / total)) if total else 1.0

    def bits(self, keys: np.ndarray) -> np.ndarray:
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys.astype(np.int32)), len(self.keys) - 1)
            n = np.where(self.keys[at] == keys, self.n[at], 0)
        else:
            n = 0
        return -np.log2((n + BACKOFF * self.low[keys % (V * V)]) / (self.ctx3[keys // V] + BACKOFF))

    def one(self, k: int) -> float:
        return float(self.bits(np.array([k]))[0])

    def odd(self, ids: np.ndarray, lens: np.ndarray, above: float, below: float) -> np.ndarray:
        """Which segments have an abnormal perplexity: mean surprise beyond what segments of this length have in prose."""
        n = lens + 1
        b = np.add.reduceat(self.bits(trigrams(ids, lens)), np.cumsum(n) - n) / n if len(lens) else np.empty(0)
        spread = self.sd / np.sqrt(n)
        return (b > self.mean + max(above * self.sd, LEAST) + spread) | (b < self.mean - max(below * self.sd, LEAST) - 0.25 * spread)


#: Standard deviations of one symbol's surprise by which a segment's mean may exceed, or fall below, that of prose.
ABOVE, BELOW = 0.55, 0.55
SHARE = 0.5


def page_shares(docs: DataFrame, row_id: str, text: str, above: float = ABOVE, below: float = BELOW) -> DataFrame:
    """(row_id, share): the share of each document's characters that is not prose.

    Null and blank texts have share 0; texts are read whole; copies count each; an empty table gives no rows; a
    collection without any prose sentence has no model and every share is 0; other columns are not read.
    """
    encoded = cut(read(docs, row_id, text))
    model = train(encoded)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the alphabet
    kind = dict(docs.dtypes)[row_id]
    known = len(model.keys) > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            share = np.zeros(len(b))
            lens = _flat(b["lens"], np.int64)
            if known and len(lens):
                chars = _flat(b["chars"], np.int64)
                odd = m.odd(_flat(b["ids"], np.int64), lens, above, below)
                doc = np.repeat(np.arange(len(b)), b["lens"].map(len).to_numpy())
                total = np.bincount(doc, weights=chars, minlength=len(b))
                share = np.bincount(doc, weights=chars * odd, minlength=len(b)) / np.maximum(total, 1)
            yield pd.DataFrame({row_id: b[row_id], "share": pd.Series(share, index=b.index, dtype="float64")})

    return encoded.select(row_id, "ids", "lens", "chars").mapInPandas(run, f"`{row_id}` {kind}, share double")


def p8_found(spark, sf_dir: str) -> DataFrame:
    return page_shares(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text").where(F.col("share") > SHARE).select("doc_id")


QUERIES = {"p8_found": p8_found}
SQL: dict[str, str] = {}
