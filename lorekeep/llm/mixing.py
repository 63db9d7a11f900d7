"""Mixing sources to target weights.

Method: a multivariate-hypergeometric splitting tree.  Every source's documents are hashed into blocks; a source's quota
is a whole number of block instances (a block and the number of its copy).  The quotas are split
recursively: half of the output shards get a multivariate-hypergeometric draw from the pool of block instances, the
other half the rest, down to single shards.  Each shard then takes the next disjoint stretch of every source's permuted blocks and is
shuffled locally.  A shard is thus a uniform draw without replacement from the whole mix, yet nothing is sorted globally.

Sizes are tokens of a public tokenizer.  The block table (at most ``BLOCKS`` a source) and the tree are driver-side and of
bounded size; documents are tokenised in place and join the block map by (source, block).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.runtime import clean, cut

#: Most blocks of a source; documents a block holds at least on average; most sources; tokens aimed at per shard.
BLOCKS, BLOCK_DOCS, SOURCES, SHARD_TOKENS = 4_096, 4, 10_000, 1_000_000
#: Tokenizer files: folder and name of a tiktoken rank file.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
# Fixed value: the public byte-level BPE's pattern for cutting text into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoding: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file (one ``base64 rank`` pair a line), kept per process."""
    if path not in _encoding:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoding[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoding[path]


def token_counts(docs: DataFrame, ident: str, source: str, text: str, path: str) -> DataFrame:
    """(id, source, n_tokens): tokens of each document's whole text; null texts have 0, sources are cleaned, documents without an id left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoding(path)
        for pdf in batches:
            n = [len(e.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["t"]]
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "n_tokens": n})

    kind = dict(docs.dtypes)[ident]
    return docs.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), clean(F.col(source)).alias("source"), F.col(text).alias("t")).mapInPandas(
        run, f"id {kind}, source string, n_tokens long"
    )


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "big"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int = 7) -> np.ndarray:
    """(shards, sources): whole-number quotas of each shard; columns add up to ``quotas``, row totals differ by at most 1."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        a, b, q = todo.pop()
        if b - a == 1:
            out[a] = q
            continue
        mid, total = (a + b) // 2, int(q.sum())
        left = total * (mid - a) // (b - a)
        draw = _rng(seed, a, b).multivariate_hypergeometric(q, left, method="marginals") if 0 < left < total else q * (left == total and total > 0)
        todo += [(a, mid, draw), (mid, b, q - draw)]
    return out


def quotas_of(blocks: dict[str, list[int]], targets: dict[str, tuple[float, int]], total: float, seed: int = 7) -> dict[str, list[tuple[int, int]]]:
    """Per source its block instances (block, copy) in drawing order, whose tokens come nearest to share x total.

    Copy 0 of all blocks is drawn before copy 1 of any; every copy has its own permutation; no block has more than
    ``max_repeats`` copies.
    """
    out = {}
    for s, (share, repeats) in targets.items():
        size, want, have, got = blocks.get(s, []), share * total, 0, []
        for copy in range(max(0, repeats)):
            if not size or have >= want:
                break
            for b in _rng(seed, s, copy).permutation(len(size)):
                if not size[b]:
                    continue
                if have + size[b] - want > want - have:
                    break
                have += size[b]
                got.append((int(b), copy))
            else:
                continue
            break
        out[s] = got
    return out


def plan(
    sized: DataFrame, targets: DataFrame, total: float | None = None, shard_tokens: int = SHARD_TOKENS, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """((source, block, copy, shard), (source, target_share, available, tokens, actual_share, max_repeats, max_copies)).

    ``sized``: (id, source, n_tokens).  ``total`` is the size aimed at, by default the tokens available from the targeted
    sources.  A source that cannot reach its share within its repeats gives all it may; the others keep their sizes,
    so the mix is smaller and the reported shares say by how much each differs.
    """
    spark = sized.sparkSession
    rows = targets.select(clean(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    want = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows}
    known = F.broadcast(spark.createDataFrame([(s,) for s in want], "source string"))
    per = {r.source: r for r in sized.join(known, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    count = {s: max(1, min(BLOCKS, per[s].n // BLOCK_DOCS)) if s in per else 0 for s in want}
    table = (
        blocked(sized, count, seed).groupBy("source", "block").agg(F.sum("n_tokens").alias("t")).collect()
    )  # at most BLOCKS rows a source
    blocks = {s: [0] * n for s, n in count.items()}
    for r in table:
        blocks[r.source][r.block] = r.t
    total = total if total is not None else float(sum(p.t for p in per.values()))
    drawn = quotas_of(blocks, want, total, seed)
    names = list(want)
    tokens = {s: sum(blocks[s][b] for b, _ in drawn[s]) for s in names}
    mixed = sum(tokens.values())
    shards = max(1, min(sum(map(len, drawn.values())), round(mixed / shard_tokens)))
    split = split_quotas(np.array([len(drawn[s]) for s in names]), shards, seed)
    ends = np.cumsum(split, axis=0)
    where = [
        (s, b, c, int(np.searchsorted(ends[:, k], i, side="right"))) for k, s in enumerate(names) for i, (b, c) in enumerate(drawn[s])
    ]
    placed = spark.createDataFrame(pd.DataFrame(where, columns=["source", "block", "copy", "shard"]), "source string, block int, copy int, shard int") if where else spark.createDataFrame([], "source string, block int, copy int, shard int")
    report = [
        (s, want[s][0], int(per[s].t) if s in per else 0, tokens[s], tokens[s] / mixed if mixed else 0.0, want[s][1], max((c + 1 for _, c in drawn[s]), default=0))
        for s in names
    ]
    return placed, spark.createDataFrame(
        report, "source string, target_share double, available long, tokens long, actual_share double, max_repeats int, max_copies int"
    )


def blocked(sized: DataFrame, count: dict[str, int], seed: int = 7) -> DataFrame:
    """Adds the block of each document of a targeted source: a hash of its id, even within the source."""
    per = sized.sparkSession.createDataFrame([(s, n) for s, n in count.items() if n] or [("", 1)], "source string, n_blocks int")
    return sized.join(F.broadcast(per), "source").withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("n_blocks")).cast("int"))


def mix_sources(
    docs: DataFrame, targets: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text",
    total: float | None = None, shard_tokens: int = SHARD_TOKENS, seed: int = 7, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """((shard, pos, doc_id, copy, source, n_tokens), report): the mix, shuffled within shards, and the shares reached.

    Documents without a targeted source take no part.  See ``plan`` for sizes; empty inputs give an empty mix and zero shares.
    """
    sized = cut(token_counts(docs, ident, source, text, os.path.join(tokenizers, vocabulary)))
    placed, report = plan(sized, targets, total, shard_tokens, seed)
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.floor(F.col("n") / BLOCK_DOCS))).cast("int")
    names = placed.select("source").distinct()
    count = {r.source: r.k for r in per.join(F.broadcast(names), "source").select("source", blocks.alias("k")).collect()}
    inst = blocked(sized, count, seed).join(F.broadcast(placed), ["source", "block"])  # at most BLOCKS x repeats rows a source
    order = Window.partitionBy("shard").orderBy(F.xxhash64("id", "copy", F.lit(seed)), "id", "copy")
    return (
        inst.select("shard", F.row_number().over(order).alias("pos"), F.col("id").alias(ident), "copy", "source", "n_tokens"),
        report,
    )


def own_tokenizers(spark: SparkSession) -> str:
    """Folder of the tokenizer files: the setting ``lorekeep.tokenizers``, else the default."""
    return spark.conf.get("lorekeep.tokenizers", TOKENIZERS)
