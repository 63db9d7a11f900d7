"""Vector functions: cosine, centroids, blocked similarity, top-k."""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lorekeep.runtime import cut

#: Values (rows x dimensions) of a query side that may be broadcast: 256 MB of doubles.
QUERY_VALUES = 32_000_000
#: Values of the query side that a task of ``similar_to`` holds: 64 MB of doubles.
SIDE_VALUES = 8_000_000
#: Query rows multiplied at a time.
BLOCK = 2048
#: Candidate pairs decided at a time, and the margin of single precision.
PAIRS, SLACK = 65_536, 1e-4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0, null where a vector is null or lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def usable(v: Column, dims: int = 64) -> Column:
    return v.isNotNull() & (F.size(v) == dims) & F.exists(v, lambda x: x != 0)


def centroids(members: DataFrame, group: str, embedding: str) -> DataFrame:
    """(group, centroid): unit mean vector of each group; map-side combined per component, no vector is gathered."""
    at = members.where(F.col(embedding).isNotNull()).select(group, F.posexplode(embedding).alias("p", "x"))
    mean = at.groupBy(group, "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    v = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda t: t["m"]).alias("mean"))
    return v.select(group, F.transform("mean", lambda x: x / (norm(F.col("mean")) + F.lit(1e-8))).alias("centroid"))


def _unit(rows) -> np.ndarray:
    m = np.array(list(rows), dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _query_block(queries: DataFrame, ident: str, embedding: str) -> tuple[list, np.ndarray]:
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(embedding)), F.lit(0))).first()
    if n * width > QUERY_VALUES:
        raise ValueError(f"{n} queries of {width} values; take them in several calls of at most {QUERY_VALUES // max(1, width)} rows")
    rows = queries.select(ident, embedding).collect()
    return [r[0] for r in rows], _unit([r[1] for r in rows]) if rows else np.zeros((0, 0))


def _packed(side: DataFrame) -> tuple[list, np.ndarray]:
    """Ids and unit vectors of (id, v), which come to the driver as bytes, not as Python numbers."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = _unit(pdf["v"])
                yield pd.DataFrame({"ids": [pickle.dumps(list(pdf["id"]))], "m": [m.tobytes()], "width": [m.shape[1]]})

    parts = side.mapInPandas(pack, "ids binary, m binary, width int").collect()
    if not parts:
        return [], np.zeros((0, 0))
    return [i for p in parts for i in pickle.loads(bytes(p.ids))], np.concatenate([np.frombuffer(p.m).reshape(-1, p.width) for p in parts])


def _matrix(column) -> np.ndarray:
    """Unit vectors of an Arrow column of lists of one length."""
    width = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(width) != 1 or width[0] is None:
        raise ValueError(f"vectors of {width} values")
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width[0])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def similar_to(queries: DataFrame, rows: DataFrame, least: float, ident: str = "id", embedding: str = "embedding", below: float = 1.01, values: int = SIDE_VALUES, once: str | None = None) -> DataFrame:
    """(q, id, cosine): every (query, row) with ``least`` <= cosine < ``below``, ids different.

    The queries are taken in parts of about ``values`` values, of which a task holds one; it is multiplied with all rows
    block by block, and the rows are neither shuffled nor gathered.  A product in single precision finds the candidates, with
    a margin above its error; double precision decides.  Pairs go on as they are found: none is stored or shuffled here.
    ``once``: a column of ``rows``, true for rows that are queries too; of two of them only the one with the larger id asks.
    """
    qt, rt = dict(queries.dtypes)[ident], dict(rows.dtypes)[ident]
    qa = to_arrow_type(queries.schema[ident].dataType)
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(embedding)), F.lit(0))).first()
    parts = max(1, -(-n * width // values))
    side = queries.select(F.col(ident).alias("id"), F.col(embedding).alias("v"))
    src = rows.select(F.col(ident).alias("id"), F.col(embedding).alias("v"), (F.col(once) if once else F.lit(False)).alias("once"))
    if parts > 1:
        side, src = cut(side.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))), cut(src)

    def matches(side: DataFrame) -> DataFrame:
        ids, m = _packed(side)
        shared = rows.sparkSession.sparkContext.broadcast((pa.array(ids, qa), m))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            small = m.astype(np.float32)
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                names, twice = batch.column("id"), batch.column("once").to_numpy(zero_copy_only=False).astype(bool)
                x = _matrix(batch.column("v"))

                def decided(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
                    for t in range(0, len(i), PAIRS):
                        p, q = i[t : t + PAIRS], j[t : t + PAIRS]
                        g = np.einsum("ij,ij->i", m[p], x[q])  # noqa: B023
                        k = np.flatnonzero((g >= least) & (g < below))
                        p, q, g = p[k], q[k], g[k]
                        a, b = ids.take(pa.array(p)), names.take(pa.array(q))  # noqa: B023
                        if qt == rt:
                            keep = pc.not_equal(a, b).to_numpy(zero_copy_only=False) & ~(twice[q] & pc.less(a, b).to_numpy(zero_copy_only=False))  # noqa: B023
                            a, b, g = a.filter(pa.array(keep)), b.filter(pa.array(keep)), g[keep]
                        if len(g):
                            yield pa.RecordBatch.from_arrays([a, b, pa.array(g)], ["q", "id", "cosine"])

                found, held = [], 0
                for r in range(0, len(x), BLOCK):
                    columns = x[r : r + BLOCK].astype(np.float32).T
                    wide = columns.shape[1]
                    for s in range(0, len(ids), BLOCK):
                        at = np.flatnonzero((small[s : s + BLOCK] @ columns).ravel() >= np.float32(least - SLACK))
                        if len(at):
                            found.append((at // wide + s, at % wide + r))
                            held += len(at)
                        if held >= PAIRS:
                            yield from decided(*map(np.concatenate, zip(*found, strict=True)))
                            found, held = [], 0
                if found:
                    yield from decided(*map(np.concatenate, zip(*found, strict=True)))

        return src.mapInArrow(run, f"q {qt}, id {rt}, cosine double")

    out = None
    for k in range(parts):
        found = matches(side.where(F.col("part") == k).select("id", "v") if parts > 1 else side)
        out = found if out is None else out.unionByName(found)
    return out


def top_k(
    queries: DataFrame, rows: DataFrame, k: int, ident: str = "id", embedding: str = "embedding", weight: Column | None = None
) -> DataFrame:
    """(q, id, score, rank): the k best rows of each query by cosine, or by cosine x ``weight``; ties by smaller id; exact.

    Every batch of rows passes on its own best k per query, so at most k rows per query and batch are shuffled.
    """
    ids, m = _query_block(queries, ident, embedding)
    shared = rows.sparkSession.sparkContext.broadcast((ids, m))
    qt, rt = dict(queries.dtypes)[ident], dict(rows.dtypes)[ident]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m = shared.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            order = np.argsort(pdf["id"].to_numpy().astype(str), kind="stable")
            x, w, names = _unit(pdf["v"])[order], pdf["w"].to_numpy()[order], pdf["id"].to_numpy()[order]
            for s in range(0, len(ids), BLOCK):
                g = (m[s : s + BLOCK] @ x.T) * w
                # all rows as good as the k-th are kept in sight, so that ties go to the smaller id
                if g.shape[1] > 4 * k:
                    bar = -np.partition(-g, k - 1, axis=1)[:, k - 1 : k]
                    a, b = np.nonzero(g >= bar)
                    o = np.lexsort((b, -g[a, b], a))
                    a, b = a[o], b[o]
                    first = np.searchsorted(a, np.arange(len(g)))
                    keep = np.arange(len(a)) - first[a] < k
                    a, b = a[keep], b[keep]
                else:
                    top = np.argsort(-g, axis=1, kind="stable")[:, :k]
                    a, b = np.repeat(np.arange(len(g)), top.shape[1]), top.ravel()
                yield pd.DataFrame({"q": [ids[s + i] for i in a], "id": names[b], "score": g[a, b]})

    src = rows.select(F.col(ident).alias("id"), F.col(embedding).alias("v"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return src.mapInPandas(run, f"q {qt}, id {rt}, score double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@F.pandas_udf(T.StringType())
def encode_vector(v: pd.Series) -> pd.Series:
    """base64 of little-endian float32 values."""
    return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, dtype="<f4").tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), dtype="<f4"))
