"""Subject areas of each document.

Method: curated, weighted subject terms are found in one pass with a multi-pattern automaton.  A sentence's score for a
subject is the sum of its terms' weights, each multiplied by its rarity, over the sentence's length; it is about the
subject if the score reaches ``DENSITY``.  A document gets every subject whose share of sentences
reaches the subject's threshold, calibrated on the human labels around the nominal quarter.

Scale: documents stream through one Arrow stage; only term counts (one per curated term) and share histograms of the
labelled documents (subjects x 100 cells) reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.lexicon import FIRM, LOOSE
from lorekeep.runtime import clean, cut

SUBJECTS = tuple(FIRM)
NOMINAL, LOWEST, HIGHEST = 0.25, 0.20, 0.30
DENSITY = 0.045
LOOSE_WEIGHT = 0.5

#: Sentences end at . ! or ? before white space, at a blank line, and before a line that opens a list item, a turn or a log
#: entry.  Other line breaks are wraps.  Lead-ins, quotation marks of mail and table bars are no part of a sentence.
_LEAD = re.compile(r"^\s*(?:[-*>#|]+\s+|\d+[.)]\s+|\[\w+\]:\s*|(?:\w+=\S+\s+)+(?:\w+:\s+)?|</?[\w-]+>\s*)*")
_WRAP = re.compile(r"[>|\s]*")
_STOP = re.compile(r"(?<=[.!?])[\"”’)]*\s+")
_DONE = re.compile(r"[.!?][\"”’)]*\s*$")
_WORD = re.compile(r"[^\W_]+")


def _blocks(text: str) -> Iterator[str]:
    held: list[str] = []
    for line in text.split("\n"):
        lead = _LEAD.match(line).group()
        rest = line[len(lead) :].rstrip(" |\t\r")
        if held and (not rest or not _WRAP.fullmatch(lead) or _DONE.search(held[-1])):
            yield " ".join(held)
            held = []
        if rest:
            held.append(rest)
    if held:
        yield " ".join(held)


def sentences(text: str) -> Iterator[str]:
    """Sentences of at least two words; a remark in brackets alone is none."""
    for block in _blocks(text):
        for s in _STOP.split(block):
            if len(_WORD.findall(s)) >= 2 and not (s.startswith("(") and s.rstrip(" .").endswith(")")):
                yield s


def terms() -> list[tuple[str, str, float]]:
    """(term, subject, weight)."""
    return [(t, s, 1.0) for s, x in FIRM.items() for t in x.split()] + [(t, s, LOOSE_WEIGHT) for s, x in LOOSE.items() for t in x.split()]


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in {t for t, _, _ in terms()}:
        a.add_word(t, t)
    a.make_automaton()
    return a


def _ends(low: str, at: int) -> int:
    """Where a term that ends before ``at`` ends as a word: there, or after a plural s or es; else -1."""
    n = len(low)
    for tail in ("", "s", "es", "en", "n", "’s", "'s"):
        e = at + len(tail)
        if low.startswith(tail, at) and (e == n or not (low[e].isalnum() or low[e] == "_")):
            return e
    return -1


def hits(sentence: str, automaton) -> list[str]:
    """Terms in a sentence, whole words only; not those right after a capitalised word within the sentence, which makes
    them part of a name."""
    low = sentence.lower()
    if len(low) != len(sentence):
        sentence = low
    found = []
    for end, t in automaton.iter(low):
        start = end - len(t) + 1
        if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
            continue
        if _ends(low, end + 1) < 0:
            continue
        before = sentence[:start].rstrip().rpartition(" ")
        if before[1] and before[2][:1].isupper() and before[2][1:].islower() and start == len(sentence[:start].rstrip()) + 1:
            continue
        found.append(t)
    return found


def sentence_hits(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, lens, terms): sentences of each document; for those with hits their length in words and their terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = _automaton()
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["text"], strict=True):
                n, lens, found = 0, [], []
                for s in sentences(t) if isinstance(t, str) else ():
                    n += 1
                    if h := hits(s, a):
                        lens.append(len(_WORD.findall(s)))
                        found.append(h)
                if n:
                    out.append((i, n, lens, found))
            yield pd.DataFrame(out, columns=["id", "n", "lens", "terms"])

    kind = dict(docs.dtypes)[ident]
    return docs.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInPandas(
        run, f"id {kind}, n int, lens array<int>, terms array<array<string>>"
    )


def rarity(found: DataFrame) -> dict[str, float]:
    """0.7 to 1.3 for each curated term: rarer terms weigh more.  Counted over all documents."""
    n = found.count()
    counts = {r.t: r["count"] for r in found.select(F.explode(F.array_distinct(F.flatten("terms"))).alias("t")).groupBy("t").count().collect()}
    if not counts:
        return {}
    logs = {t: math.log((n + 1) / c) for t, c in counts.items()}
    mid = sorted(logs.values())[len(logs) // 2]
    return {t: min(1.3, max(0.7, v / mid)) if mid else 1.0 for t, v in logs.items()}


def shares_of(n: int, lens, found, of: dict[str, list[tuple[str, float]]], rare: dict[str, float]) -> dict[str, float]:
    """Share of a document's sentences that are about each subject."""
    sure: dict[str, float] = {}
    firm: set[str] = set()
    for row in found:
        for t in row:
            firm |= {s for s, w in of[t] if w == 1.0}
            if len(of[t]) == 1:
                s, w = of[t][0]
                sure[s] = sure.get(s, 0) + w
    about: dict[str, int] = {}
    for size, row in zip(lens, found, strict=True):
        score: dict[str, float] = {}
        for t in row:
            # a term of several subjects goes to the one with most evidence in the document
            s, w = max(of[t], key=lambda x: (sure.get(x[0], 0), x[1])) if len(of[t]) > 1 else of[t][0]
            if s not in firm or (len(of[t]) > 1 and not sure.get(s)):
                continue
            score[s] = score.get(s, 0) + w * rare.get(t, 1.0)
        for s, v in score.items():
            if v / size >= DENSITY:
                about[s] = about.get(s, 0) + 1
    return {s: k / n for s, k in about.items()}


def subject_shares(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, subject, share): share of the document's sentences about each subject, where there are any."""
    found = cut(sentence_hits(docs, ident, text))
    rare = rarity(found)
    of: dict[str, list[tuple[str, float]]] = {}
    for t, s, w in terms():
        of.setdefault(t, []).append((s, w))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (i, s, v)
                for i, n, lens, terms_ in zip(pdf["id"], pdf["n"], pdf["lens"], pdf["terms"], strict=True)
                for s, v in shares_of(n, lens, terms_, of, rare).items()
            ]
            yield pd.DataFrame(out, columns=["id", "subject", "share"])

    return found.where("size(lens) > 0").mapInPandas(run, f"id {dict(found.dtypes)['id']}, subject string, share double")


def calibrate(shares: DataFrame, labels: DataFrame, ident: str = "doc_id") -> dict[str, float]:
    """Share threshold per subject with the best F1 on the labelled documents, within LOWEST and HIGHEST.

    Of equally good ones the nearest to the nominal quarter is taken; without labels it is the quarter.  Labels are
    cleaned; a document's label ``none`` means no subject.  All labels are used, as histograms of 100 cells.
    """
    y = labels.select(F.col(ident).alias("id"), clean(F.col("subject")).alias("label")).where("label is not null").distinct()
    known = y.select("id").distinct()
    cell = F.least(F.lit(99), F.floor(F.col("share") * 100)).cast("int")
    got = shares.join(known, "id").select("id", F.col("subject").alias("label"), cell.alias("cell"))
    table = got.join(y.withColumn("yes", F.lit(1)), ["id", "label"], "left").groupBy("label", "cell").agg(
        F.sum(F.coalesce("yes", F.lit(0))).alias("tp"), F.count(F.lit(1)).alias("n")
    )
    total = {r.label: r["count"] for r in y.where(F.col("label").isin(*SUBJECTS)).groupBy("label").count().collect()}
    cells: dict[str, dict[int, tuple[int, int]]] = {}
    for r in table.collect():
        cells.setdefault(r.label, {})[r.cell] = (r.tp, r.n)
    out = {}
    for s in SUBJECTS:
        best = (-1.0, 0.0, NOMINAL)
        for c in range(round(LOWEST * 100), round(HIGHEST * 100) + 1):
            tp = sum(t for k, (t, _) in cells.get(s, {}).items() if k >= c)
            n = sum(m for k, (_, m) in cells.get(s, {}).items() if k >= c)
            f1 = round(2 * tp / (n + total[s]), 3) if s in total and n + total[s] else 0.0
            best = max(best, (f1, -abs(c / 100 - NOMINAL), c / 100))
        out[s] = best[2]
    return out


def document_subjects(docs: DataFrame, labels: DataFrame | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id column, subject, share): every subject whose share of sentences reaches its threshold.

    Null, empty and wordless texts and null ids have no row; other columns are ignored.
    """
    shares = cut(subject_shares(docs, ident, text))
    limit = calibrate(shares, labels, ident) if labels is not None else dict.fromkeys(SUBJECTS, NOMINAL)
    least = F.create_map(*[x for s, v in limit.items() for x in (F.lit(s), F.lit(v))])[F.col("subject")]
    return shares.where(F.col("share") >= least - 1e-9).select(F.col("id").alias(ident), "subject", "share")
