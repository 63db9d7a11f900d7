"""Evaluation texts leaking into training text.

Method: a broadcast hash set of the test items' word n-grams; training texts are scanned window by window.  Words of
the test vocabulary get numbers, a window of numbers is looked up in the set, and as the numbers stand for the words
themselves a hit is verified at once.  Leaked spans are cut out, or documents dropped.

Scale: one pass over the documents, no shuffle.  The set holds at most as many n-grams as the test items have
words; beyond ``MOST`` it is not broadcast but joined with the documents' n-grams, with the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.runtime import cut

NGRAM = 8
#: Most words of test items that are broadcast: some 200 MB in each Python worker.
MOST = 500_000

_WORD = re.compile(r"[a-z0-9]+")


def _lowered(text: str):
    """The text in lower case, and where a place in it is in the text: a letter may be longer in lower case."""
    low = text.lower()
    if len(low) == len(text):
        return low, lambda i: i
    place = [i for i, c in enumerate(text) for _ in c.lower()]
    if len(place) != len(low):  # lower case by context
        low = "".join(c.lower() for c in text)
    place.append(len(text))
    return low, lambda i: place[i]


class NgramSet:
    """n-grams of the test items: vocabulary, window -> items."""

    def __init__(self, items: list[tuple], n: int = NGRAM):
        self.n, self.vocabulary, self.windows = n, {}, {}
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in _WORD.findall((text or "").lower())]
            for i in range(len(w) - n + 1):
                self.windows.setdefault(tuple(w[i : i + n]), set()).add(item)

    def scan(self, text: str) -> Iterator[tuple[int, int, set]]:
        """(first character, end, items) of every window of the text that is in the set."""
        low, at = _lowered(text)
        run: list[tuple[int, int, int]] = []
        get, n = self.vocabulary.get, self.n
        for m in _WORD.finditer(low):
            k = get(m.group())
            if k is None:
                run.clear()
                continue
            run.append((k, m.start(), m.end()))
            if len(run) >= n:
                found = self.windows.get(tuple(x[0] for x in run[-n:]))
                if found:
                    yield at(run[-n][1]), at(run[-1][2]), found
                if len(run) > 64 * n:
                    del run[: -n]


def _set_of(items: DataFrame, ident: str, text: str, n: int, most: int) -> NgramSet | None:
    """The items' n-grams; None if they have more than ``most`` words."""
    words = items.select(F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)).alias("w"))
    if (words.agg(F.sum("w")).first()[0] or 0) > most:
        return None
    return NgramSet([(r[0], r[1]) for r in items.select(ident, text).where(F.col(text).isNotNull() & F.col(ident).isNotNull()).collect()], n)


def _ngrams(rows: DataFrame, n: int) -> DataFrame:
    """(d, a, b, gram): every n-gram of the texts (columns d, t) with its first character and end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, t in zip(pdf["d"], pdf["t"], strict=True):
                low, at = _lowered(t)
                w = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(low)]
                out = [(d, at(w[i][1]), at(w[i + n - 1][2]), " ".join(x[0] for x in w[i : i + n])) for i in range(len(w) - n + 1)]
                yield pd.DataFrame(out, columns=["d", "a", "b", "gram"])

    return rows.where("d is not null and t is not null").mapInPandas(run, f"d {dict(rows.dtypes)['d']}, a long, b long, gram string")


def _joined_hits(rows: DataFrame, items: DataFrame, ident: str, text: str, n: int) -> DataFrame:
    """(d, a, b, item): windows of the texts that are n-grams of an item, by a join."""
    grams = _ngrams(items.select(F.col(ident).alias("d"), F.col(text).alias("t")), n).select(F.col("d").alias("item"), "gram").distinct()
    return _ngrams(rows, n).join(grams, "gram").select("d", "a", "b", "item")


def _without(text: str, windows: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text, spans, characters cut): each maximal stretch of the windows, given in order, becomes one space."""
    spans: list[list[int]] = []
    for a, b in windows:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    kept = text
    for a, b in reversed(spans):
        kept = kept[:a].rstrip() + " " + kept[b:].lstrip()
    return kept, len(spans), sum(b - a for a, b in spans)


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", n: int = NGRAM, most: int = MOST
) -> DataFrame:
    """(doc_id, item_id, n_windows): items of which the document holds at least ``n`` consecutive words, with the number of hits.

    Items that share the text each have a row; texts and items shorter than ``n`` words, null texts and null ids have none.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    held = _set_of(items, item_id, text, n, most)
    if held is None:
        hits = _joined_hits(rows, items, item_id, text, n).groupBy(F.col("d").alias("doc_id"), F.col("item").alias("item_id"))
        return hits.agg(F.count(F.lit(1)).alias("n_windows"))
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for pdf in batches:
            out = []
            for d, t in zip(pdf["d"], pdf["t"], strict=True):
                seen: dict = {}
                if isinstance(t, str):
                    for _, _, found in s.scan(t):
                        for i in found:
                            seen[i] = seen.get(i, 0) + 1
                out += [(d, i, k) for i, k in seen.items()]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_windows"])

    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {dict(items.dtypes)[item_id]}, n_windows long"
    return rows.mapInPandas(run, schema)


def without_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    n: int = NGRAM, drop_share: float = 0.5, most: int = MOST,
) -> DataFrame:
    """(doc_id, n_spans, n_cut, text): documents without the leaked passages; each maximal leaked span becomes one space.

    Where the words on both sides of a cut make a passage of an item again, that is cut as well, until none is left.  A document
    of which more than ``drop_share`` of the characters leaked is dropped whole.  Null texts pass unchanged,
    documents without an id are left out.  Letters keep their case.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, n_spans int, n_cut long, text string"
    held = _set_of(items, item_id, text, n, most)
    if held is None:
        return _cut_by_join(rows, items, item_id, text, n, drop_share)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        for pdf in batches:
            out = []
            for d, t in zip(pdf["d"], pdf["t"], strict=True):
                kept, spans, gone = t, 0, 0
                while isinstance(kept, str) and (found := [(a, b) for a, b, _ in s.scan(kept)]):
                    kept, k, g = _without(kept, found)
                    spans, gone = spans + k, gone + g
                if not spans or gone <= drop_share * len(t):
                    out.append((d, spans, gone, kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_spans", "n_cut", "text"])

    return rows.mapInPandas(run, schema)


def _cut_by_join(rows: DataFrame, items: DataFrame, ident: str, text: str, n: int, drop_share: float) -> DataFrame:
    """The same with the windows found by a join: each round takes the documents that the one before has cut."""
    kind = dict(rows.dtypes)["d"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, doc, t, size, spans, gone, w in zip(*(pdf[c] for c in ("d", "doc", "t", "size", "spans", "gone", "w")), strict=True):
                kept, k, g = _without(t, sorted((x["a"], x["b"]) for x in w))
                out.append((d, doc, kept, size, spans + k, gone + g))
            yield pd.DataFrame(out, columns=["d", "doc", "t", "size", "spans", "gone"])

    # rows have numbers of their own, as ids may repeat
    rows = cut(rows.select(F.monotonically_increasing_id().alias("d"), F.col("d").alias("doc"), "t"))
    todo = rows.select("d", "doc", "t", F.length("t").cast("long").alias("size"), F.lit(0).alias("spans"), F.lit(0).cast("long").alias("gone"))
    done = None
    while True:
        hits = _joined_hits(todo.select("d", "t"), items, ident, text, n).select("d", "a", "b").distinct()
        hits = cut(hits.groupBy("d").agg(F.collect_list(F.struct("a", "b")).alias("w")))  # a document's own windows
        clean = todo.join(hits, "d", "left_anti")
        done = clean if done is None else done.unionByName(clean)
        if hits.isEmpty():
            break
        todo = cut(todo.join(hits, "d").mapInPandas(run, f"d long, doc {kind}, t string, size long, spans int, gone long"))
    kept = done.where(F.col("size").isNull() | (F.col("spans") == 0) | (F.col("gone") <= drop_share * F.col("size")))
    return kept.select(F.col("doc").alias("doc_id"), F.col("spans").alias("n_spans"), F.col("gone").alias("n_cut"), F.col("t").alias("text"))
