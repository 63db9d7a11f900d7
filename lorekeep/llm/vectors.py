"""Most similar vectors for every vector.

Method: one hierarchical navigable small-world graph per shard (``hnsw``), stored as flat neighbour arrays, with
the shards' results merged.  Vectors go to the shard of their nearest centroid; centroids are fitted by spherical
k-means on a bounded sample (at most ``SAMPLE`` rows), so dense regions get more shards.  A shard that outgrows ``SPLIT`` rows
gets centroids of its own, fitted on a sample of its rows, and so on; the number of shards is not limited.  A vector
also asks every other shard whose centroid is nearly as close to it as its own (within ``margin`` of cosine).  Every
row is indexed, and every row searches the graph of its own shard and of the shards it asks.

Exact copies are one class before indexing, so a vector that makes up a third of all rows is indexed
once.  Rows that k-means cannot part (nearly equal ones) are split by hash, and their askers ask all parts.

Scale: a task holds one shard and at most about ``ASKERS`` asking vectors; a shard asked by more is searched in several
tasks.  The driver holds the centroids, one per shard.

Recall: pairs of cosine 0.9 in 64 dimensions lie in asked shards in more than 98 of 100 cases and are met by the
search in 99; tests measure the product against brute force, with the values of ``ef`` and ``margin`` used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.hnsw import Graph
from lorekeep.runtime import cut

#: Rows from which centroids are fitted at most; rows aimed at per shard; rows at which a shard is split; centroids fitted
#: at once at most; levels of splitting; asking vectors in a task.
SAMPLE, SHARD, SPLIT, FANOUT, LEVELS, ASKERS = 65_536, 4_096, 16_384, 1_024, 4, 16_384
#: Candidates kept by a search; cosine by which the centroid of an asked shard may be farther than the own one.
EF, MARGIN = 16, 0.06


def centroids(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means centres of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds if len(c) > 1 else 0):
        home = np.concatenate([(x[s : s + 4096] @ c.T).argmax(1) for s in range(0, len(x), 4096)])
        order = np.argsort(home, kind="stable")
        at = np.flatnonzero(np.diff(home[order], prepend=-1))
        sums = np.add.reduceat(x[order], at, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c[home[order][at]] = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c[home[order][at]])
    return c


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def usable_vectors(df: DataFrame, ident: str, embedding: str, dims: int) -> DataFrame:
    """(id, v): the rows whose vector has ``dims`` finite values, not all zero; ids may repeat."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(ident).cast("string").alias("id"), F.col(embedding).cast("array<float>").alias("v"))
    return rows.where(F.col("id").isNotNull() & (F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0))


#: A node of the tree of centroids: the centres and, for each, the shard (>= 0) or the node (-1 - its place) below.
Tree = list[tuple[np.ndarray, list[int]]]


def route(u: np.ndarray, tree: Tree, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, own) of each unit vector and each shard it belongs to or asks."""
    home, refs = np.full(len(u), -1), []  # where each vector stands, and its cosine to the centre it took on each level
    while (at := np.flatnonzero(home < 0)).size:
        ref = refs[-1].copy() if refs else np.empty(len(u), np.float32)
        below = home.copy()
        for node in np.unique(home[at]):
            rows = np.flatnonzero(home == node)
            g = u[rows] @ tree[-1 - node][0].T
            best = g.argmax(1)
            ref[rows] = g[np.arange(len(rows)), best]
            below[rows] = np.array(tree[-1 - node][1])[best]
        home = below
        refs.append(ref)
    out = [(np.arange(len(u)), home)]
    todo = [(-1, np.arange(len(u)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        g = u[rows] @ tree[-1 - node][0].T
        r, c = np.nonzero(g >= refs[min(depth, len(refs) - 1)][rows][:, None] - margin)
        below = np.array(tree[-1 - node][1])[c]
        leaf = below >= 0
        r = rows[r]
        out.append((r[leaf & (below != home[r])], below[leaf & (below != home[r])]))
        todo += [(n, r[below == n], depth + 1) for n in np.unique(below[~leaf])]
    row, shard = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    return row, shard, np.arange(len(row)) < len(u)


def _sizes(vectors: DataFrame, tree: Tree, dims: int, margin: float) -> dict[int, tuple[int, int]]:
    """Rows and askers of each shard."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, shard, own = route(_unit(_matrix(b.column("v"), dims)), shared.value, margin)
                n, m = np.bincount(shard[own]), np.bincount(shard[~own], minlength=1)
                size = max(len(n), len(m))
                n, m = np.pad(n, (0, size - len(n))), np.pad(m, (0, size - len(m)))
                at = np.flatnonzero(n + m)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(m[at])], ["shard", "n", "m"])

    counts = vectors.select("v").mapInArrow(run, "shard int, n long, m long").groupBy("shard").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return {r.shard: (r.n, r.m) for r in counts.collect()}  # one row per shard


def _split(vectors: DataFrame, tree: Tree, big: dict[int, int], dims: int, shards: int) -> int:
    """Give each shard of ``big`` (shard -> rows) centroids of its own, fitted on a sample of its rows; the new number of shards."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)
    wanted = {s: min(FANOUT, -(-n // SHARD)) for s, n in big.items()}
    rate = {s: min(1.0, min(SAMPLE, 64 * wanted[s]) / n) for s, n in big.items()}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            if not b.num_rows:
                continue
            row, shard, own = route(_unit(_matrix(b.column("v"), dims)), shared.value, -1.0)
            ids = b.column("id").to_pylist()
            take = [(r, s) for r, s, o in zip(row, shard, own, strict=True) if o and xxhash.xxh3_64_intdigest(ids[r], 11) < rate.get(s, 0) * 2**64]
            if take:
                yield pa.RecordBatch.from_arrays([pa.array([s for _, s in take], pa.int32()), b.column("v").take(pa.array([r for r, _ in take]))], ["shard", "v"])

    def fit(t: pa.Table) -> pa.Table:
        s = t.column("shard")[0].as_py()
        c = centroids(_unit(_matrix(t.column("v"), dims)), wanted[s])
        return pa.table({"shard": pa.array([s] * len(c), pa.int32()), "c": pa.array(list(c), pa.list_(pa.float32()))})

    drawn = vectors.select("id", "v").mapInArrow(draw, "shard int, v array<float>")
    fitted = drawn.groupBy("shard").applyInArrow(fit, "shard int, c array<float>").toArrow()
    owner = fitted.column("shard").to_numpy()
    centre = _matrix(fitted.column("c"), dims) if len(owner) else np.empty((0, dims), np.float32)
    for s in np.unique(owner):
        c = centre[owner == s]
        for _, kids in tree:
            if int(s) in kids:
                kids[kids.index(int(s))] = -1 - len(tree)
        tree.append((c, list(range(shards, shards + len(c)))))
        shards += len(c)
    return shards


def plant(vectors: DataFrame, n: int, dims: int, margin: float) -> tuple[Tree, dict[int, tuple[int, int]]]:
    """The tree of centroids and the rows and askers of each shard."""
    sample = vectors.select("v") if n <= SAMPLE else vectors.select("v").sample(1.05 * SAMPLE / n, seed=7).limit(SAMPLE)
    first = centroids(_unit(_matrix(sample.toArrow().column("v"), dims)), max(1, min(FANOUT, -(-n // SHARD))))
    tree: Tree = [(first, list(range(len(first))))]
    shards, sizes = len(first), _sizes(vectors, tree, dims, margin)
    stuck: set[int] = set()
    for _ in range(LEVELS - 1):
        big = {s: own for s, (own, _) in sizes.items() if own > SPLIT and s not in stuck}
        if not big:
            break
        nodes = len(tree)
        shards = _split(vectors, tree, big, dims, shards)
        sizes = _sizes(vectors, tree, dims, margin)
        for _, kids in tree[nodes:]:
            rows = [sizes.get(k, (0, 0))[0] for k in kids if k >= 0]
            stuck |= {k for k in kids if k >= 0 and sizes.get(k, (0, 0))[0] > 0.9 * sum(rows)}
    return tree, sizes


def neighbours(
    vectors: DataFrame, dims: int, k: int = 5, min_cosine: float = 0.9, margin: float = MARGIN, ef: int = EF, index: type[Graph] = Graph
) -> DataFrame:
    """(id, nbr, cosine): up to ``k`` most similar others with at least ``min_cosine`` of each id, ties by smaller id.

    ``vectors``: (id, v), finite and non-zero; a vector belongs to one id only, whose rows may repeat.  Shuffled once.
    Approximate: see the module text.
    """
    n = vectors.count()
    if n < 2:
        return vectors.select("id", F.col("id").alias("nbr"), F.lit(0.0).alias("cosine")).where("false")
    tree, sizes = plant(vectors, n, dims, margin)
    parts = {s: -(-own // SPLIT) for s, (own, _) in sizes.items() if own > SPLIT}
    chunks = {s: -(-asks // ASKERS) for s, (_, asks) in sizes.items() if asks > ASKERS}
    shared = vectors.sparkSession.sparkContext.broadcast((tree, parts, chunks))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        tree, parts, chunks = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            row, shard, own = route(_unit(_matrix(b.column("v"), dims)), tree, margin)
            part, chunk = np.zeros(len(row), np.int32), np.zeros(len(row), np.int32)
            several = np.isin(shard, [*parts, *chunks])
            if several.any():
                ids = b.column("id").to_pylist()
                more = []
                for j in np.flatnonzero(several):
                    p, c, h = parts.get(shard[j], 1), chunks.get(shard[j], 1), xxhash.xxh3_64_intdigest(ids[row[j]])
                    mine, turn = h % p, h // p % c
                    if own[j]:  # indexed in its part in every chunk, asks the other parts
                        more += [(row[j], shard[j], True, mine, x) for x in range(c)] + [(row[j], shard[j], False, q, turn) for q in range(p) if q != mine]
                    else:
                        more += [(row[j], shard[j], False, q, turn) for q in range(p)]
                r, s, o, p, c = (np.array(x) for x in zip(*more, strict=True))
                row, shard, own = (np.concatenate([x[~several], y]) for x, y in ((row, r), (shard, s), (own, o)))
                part, chunk = np.concatenate([part[~several], p]), np.concatenate([chunk[~several], c])
            t = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.astype(np.int32)) for x in (shard, part, chunk)), pa.array(own.astype(bool)), t.column("id"), t.column("v")],
                ["shard", "part", "chunk", "own", "id", "v"],
            )

    def search(t: pa.Table) -> pa.Table:
        own = t.column("own").to_numpy(zero_copy_only=False).astype(bool)
        ids = np.array(t.column("id").to_pylist(), dtype=object)
        raw = _matrix(t.column("v"), dims)
        u = _unit(raw)
        once = lambda at: at[np.unique(ids[at].astype(str), return_index=True)[1]]
        mine, asks = once(np.flatnonzero(own)), once(np.flatnonzero(~own))
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        if len(mine):
            graph = index(u[mine])
            for rows, there in ((mine, np.arange(len(mine))), (asks, None)):
                if len(rows) and (there is None or not t.column("chunk")[0].as_py()):
                    i, s = graph.search(u[rows], k + 1, ef, there)
                    r, p = np.nonzero((s >= min_cosine - 1e-4) & (i >= 0))
                    a.append(rows[r])
                    b.append(mine[i[r, p]])
        a, b = np.concatenate(a), np.concatenate(b)
        x, y = raw[a].astype(np.float64), raw[b].astype(np.float64)
        cos = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) if len(a) else np.zeros(0)
        ok = cos >= min_cosine
        return pa.table({"id": pa.array(ids[a[ok]], pa.string()), "nbr": pa.array(ids[b[ok]], pa.string()), "cosine": pa.array(cos[ok], pa.float64())})

    routed = vectors.select("id", "v").mapInArrow(send, "shard int, part int, chunk int, own boolean, id string, v array<float>")
    found = routed.groupBy("shard", "part", "chunk").applyInArrow(search, "id string, nbr string, cosine double").where("id <> nbr")
    # a few rows per id: at most k + 1 from each asked shard
    best = found.groupBy("id").agg(
        F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("neg"), "nbr"))), 1, k).alias("top")
    )
    return best.select("id", F.explode("top").alias("t")).select("id", F.col("t.nbr").alias("nbr"), (-F.col("t.neg")).alias("cosine"))


def similar_pairs(
    df: DataFrame, ident: str = "id", embedding: str = "embedding", dims: int = 64, k: int = 5, min_cosine: float = 0.9
) -> DataFrame:
    """(id_a, id_b), a < b: pairs of cosine at least ``min_cosine``, one among the ``k`` most similar others of the other.

    Ids without a finite, non-zero vector of ``dims`` values take no part; rows repeated under one id count
    once; copies of a vector are each other's most similar (ties by smaller id).  Empty tables give no pair.
    """
    rows = usable_vectors(df, ident, embedding, dims)
    print_ = F.struct(F.xxhash64("v").alias("x"), F.xxhash64("v", F.lit(1)).alias("y"))  # 128 bits for a vector
    # copies are found on fingerprints, so that whole vectors are shuffled once only, to their shards
    seen = rows.select("id", print_.alias("h")).distinct()
    several = cut(seen.groupBy("id").agg(F.min("h").alias("h"), F.max("h").alias("last")).where("h <> last").select("id", "h"))
    if not several.isEmpty():  # an id delivered with different vectors keeps one
        keep = several.withColumnRenamed("h", "keep")
        rows = rows.join(keep, "id", "left").where(F.col("keep").isNull() | (print_ == F.col("keep"))).select("id", "v")
        seen = rows.select("id", print_.alias("h")).distinct()
    copied = cut(seen.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("h", "rep"))
    if copied.isEmpty():
        near = neighbours(rows, dims, k, min_cosine)
        return near.select(F.least("id", "nbr").alias("id_a"), F.greatest("id", "nbr").alias("id_b")).distinct()
    member = cut(seen.join(copied, "h").select("rep", "id"))
    rows = rows.join(member.where("id <> rep").select("id"), "id", "left_anti")
    near = cut(neighbours(rows, dims, k, min_cosine))
    first = (
        member.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
        .groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("few"))
    )
    # what each class offers to others, and each class's other candidates, best first
    offered = near.join(first.withColumnRenamed("rep", "nbr"), "nbr", "left").select(
        F.col("id").alias("rep"), "cosine", F.explode(F.coalesce(F.slice("few", 1, k), F.array("nbr"))).alias("other")
    )
    others = offered.groupBy("rep").agg(
        F.transform(
            F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("neg"), "other"))), 1, k), lambda t: t["other"]
        ).alias("others")
    )
    single = near.select(F.col("id").alias("rep"), "id").distinct().join(member.select("rep"), "rep", "left_anti")
    everyone = single.unionByName(member)
    top = (
        everyone.join(others, "rep", "left").join(first, "rep", "left")
        .select(
            "id",
            F.slice(
                F.concat(
                    F.filter(F.coalesce("few", F.array().cast("array<string>")), lambda x: x != F.col("id")),
                    F.coalesce("others", F.array().cast("array<string>")),
                ), 1, k,
            ).alias("top"),
        )
        .select("id", F.explode("top").alias("nbr"))
    )
    return top.select(F.least("id", "nbr").alias("id_a"), F.greatest("id", "nbr").alias("id_b")).distinct()
