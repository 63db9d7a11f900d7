"""Deduplicating new batches against all history.

Method: multi-key sorted-neighbourhood runs.  Every distinct word set gets several sort keys; the keyed rows of a batch
form a run, sorted by key and stored by key range.  A new batch reads only the ranges its keys touch, is merged with
their rows, and only the windows around new records, the stretches of equal keys, are compared.  Word sets are
fetched for candidates only.  Runs of one size are compacted into one of the next size (``FAN`` at a time), so a
row is rewritten a logarithmic number of times.

Keys.  A fixed order of words, rarest first: words in more than ``LIMIT`` texts are *frequent* and ordered by their
count; all others are *rare*, in bytewise order.  (If more than ``MOST`` words are frequent, the limit is
raised so that their table stays that small; no pair is lost, but blocks of rare words grow.)  With Jaccard similarity of at
least ``t`` two sets of sizes n and m share at least ``o = ceil(t/(1+t) (n+m))`` words, so the keys below miss no pair:

* rare: each rare word among the first ``n - ceil(t n) + 1`` words;
* common: for pairs that share no rare word, the three first shared words are frequent and lie among the
  first ``c - o + 3`` frequent words, c their number: all triples of these, o by the smallest partner size that
  there is (for o < 3 single words);
* large (sets of more than 48 words, and every set that can be similar to one): each of the
  first ``n - ceil(t n) + 1`` words.

A pair that shares a rare word is found by a rare key, as its rarest shared word lies in both prefixes.

Scale: exact copies (equal word sets) are one class before any comparison, so a group of copies is compared
once; hot keys are equi-joins that AQE splits; only the frequent words, the sizes up to 48 and the numbers of
touched ranges reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.runtime import clean, cut, maybe_broadcast, partitions, shared_dir
from lorekeep.sources.versions import Versions

SIMILARITY = 0.6
LARGE = 48
#: Texts a word may be in before it is frequent; most frequent words.
LIMIT, MOST = 128, 2_000_000
#: Rows of a key range; runs of one size that are compacted; growth from which the word order is made anew.
RANGE_ROWS, FAN, STALE = 1_000_000, 4, 8
#: Keys of a class, about.
KEYS = 32
#: Batches of days that the raw memories are taken in.
BATCHES = 2

# A key row is (h, key, meta), h a 64-bit hash of the class; meta packs kind, position, frequent words and words into 2 + 3 x 20
# bits, as these rows make up most of the shuffle.
_BITS = 20
_MASK = (1 << _BITS) - 1


def words_of(text):
    """Distinct words (longest runs of a-z and 0-9 of the lower-cased text), sorted bytewise."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)))


def word_classes(texts: DataFrame, text: str, *keep: str) -> DataFrame:
    """Adds ``words``, ``cls``, a 128-bit fingerprint of the word set, and ``h``, its 64-bit hash; texts without any word or null are left out."""
    w = texts.select(*keep, words_of(F.col(text)).alias("words")).where("size(words) > 0")
    return w.withColumn("cls", F.unhex(F.substring(F.sha2(F.array_join("words", " "), 256), 1, 32))).withColumn("h", F.xxhash64("cls"))


def frequent_words(classes: DataFrame) -> dict[str, int]:
    """Words in more than ``LIMIT`` of the classes with their counts, at most about ``MOST``."""
    total = classes.agg(F.sum(F.size("words"))).first()[0] or 0
    df = classes.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > max(LIMIT, total // MOST))
    got = df.toPandas()
    return dict(zip(got["w"], got["k"].astype(int), strict=True))


def sizes_of(rows: DataFrame) -> list[int]:
    """The sizes of the word sets that common keys are made for."""
    sizes = rows.select(F.size("words").alias("n")).where(F.col("n") <= LARGE).distinct().collect()
    return sorted(r.n for r in sizes)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def keys_of(words: list[str], frequent: dict[str, int], sizes: list[int], t: float = SIMILARITY) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, n, c, pos, kind) of a set; kind 0 rare, 1 common triple, 2 large, 3 common single.

    ``sizes``: the partner sizes there are, ascending.  pos is how many words of the ordering the key reaches
    into: a later check drops windows that the sizes of the two sets rule out.
    """
    n = len(words)
    rare = [w for w in words if w not in frequent]
    common = sorted((w for w in words if w in frequent), key=lambda w: (frequent[w], w))
    c, prefix = len(common), n - math.ceil(t * n - 1e-9) + 1
    if n > LARGE * t:  # may be similar to a set of more than LARGE words
        for i, w in enumerate((rare + common)[:prefix]):
            yield _hash("L" + w), n, c, i + 1, 2
    if n > LARGE:
        return
    for i, w in enumerate(rare[:prefix]):
        yield _hash("R" + w), n, c, i + 1, 0
    partners = [m for m in sizes if math.ceil(t * n - 1e-9) <= m <= n / t + 1e-9]
    if not partners:
        return
    least, most = (math.ceil(t / (1 + t) * (n + m) - 1e-9) for m in (partners[0], partners[-1]))
    if least > c:
        return
    if least < 3:  # so few shared words that there may be no triple
        for i, w in enumerate(common[: c - least + 1]):
            yield _hash("S" + w), n, c, i + 1, 3
    if most >= 3:
        for (_, a), (_, b), (i, d) in combinations(list(enumerate(common[: c - max(least, 3) + 3])), 3):
            yield _hash(f"C{a} {b} {d}"), n, c, i + 1, 1


def keyed(classes: DataFrame, frequent: dict[str, int], sizes: list[int], t: float = SIMILARITY) -> DataFrame:
    """(h, key, meta): the sort keys of each class (columns h, words)."""
    shared = classes.sparkSession.sparkContext.broadcast((frequent, sizes))

    def pack(n: int, c: int, pos: int, kind: int) -> int:
        if n > _MASK:  # no place for such a size: positions rule nothing out
            n, c, pos = _MASK, min(c, _MASK), 0
        return kind | pos << 2 | c << 2 + _BITS | n << 2 + 2 * _BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = shared.value
        for pdf in batches:
            out = [
                (h, key, pack(n, c, pos, kind))
                for h, words in zip(pdf.h, pdf.words, strict=True)
                for key, n, c, pos, kind in keys_of(list(words), table, known, t)
            ]
            yield pd.DataFrame(out, columns=["h", "key", "meta"])

    return classes.select("h", "words").mapInPandas(run, "h long, key long, meta long")


def _part(side: str, name: str):
    at = {"pos": 2, "c": 2 + _BITS, "n": 2 + 2 * _BITS}[name]
    return F.shiftright(f"{side}.meta", at).bitwiseAND(F.lit(_MASK).cast("long"))


def windows(new: DataFrame, runs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """(a, b): classes of ``new`` and of ``runs`` (as h) that lie in one window; not yet verified.

    Both sides are sorted by key and merged; of each window only the pairs whose sizes and positions allow
    the similarity go on.
    """
    x, y = new.alias("x"), runs.alias("y")
    kind = F.col("x.meta").bitwiseAND(F.lit(3).cast("long"))
    xn, xc, xp, yn, yc, yp = (_part(s, p) for s in "xy" for p in ("n", "c", "pos"))
    o = F.ceil(F.lit(t / (1 + t)) * (xn + yn) - F.lit(1e-9))
    fits = (xn >= yn * t - 1e-9) & (yn >= xn * t - 1e-9)
    triple = (o <= F.least(xc, yc)) & (xp <= xc - o + 3) & (yp <= yc - o + 3)
    single = (xp <= xn - o + 1) & (yp <= yn - o + 1)
    large = F.greatest(xn, yn) > LARGE
    small = (kind == 1) & triple | (kind == 3) & (o < 3)
    place = F.when(kind == 0, single).when(kind == 2, single & large).otherwise(small)
    same_kind = kind == F.col("y.meta").bitwiseAND(F.lit(3).cast("long"))
    return (
        x.join(y, (F.col("x.key") == F.col("y.key")) & same_kind & (F.col("x.h") != F.col("y.h")) & fits & place)
        .select(F.col("x.h").alias("a"), F.col("y.h").alias("b"))
        .distinct()
    )


def verify(pairs: DataFrame, left: DataFrame, right: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity), a and b as cls: the pairs (of h) whose word sets reach ``t``."""
    l = left.select(F.col("h").alias("a"), F.col("cls").alias("ca"), F.col("words").alias("wa"))
    r = right.select(F.col("h").alias("b"), F.col("cls").alias("cb"), F.col("words").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    out = pairs.join(r, "b").join(l, "a").withColumn("both", both)
    sim = F.col("both") / (F.size("wa") + F.size("wb") - F.col("both"))
    return out.withColumn("similarity", sim).where(F.col("similarity") >= t).select(F.col("ca").alias("a"), F.col("cb").alias("b"), "similarity")


def range_of(column: str, bits: int):
    """The key range of a 64-bit value: its first ``bits`` bits."""
    return F.shiftrightunsigned(column, 64 - bits).cast("int") if bits else F.lit(0)


class SortedRuns:
    """Persisted runs of an accepted history in a shared folder.

    Layout: ``classes/run=K/range=R`` (h, cls, words) and ``members/run=K/range=R`` (h, cls, id, carried columns) by the first
    bits of h, ``keys/run=K/range=R`` (h, key, meta) by those of key and sorted, ``order/v=K``, the frequent words,
    and a versioned manifest, so readers see a batch accepted or not, never half.  The word order only decides
    speed: any fixed order finds every pair.  It is made from the first batch and anew when the history has grown
    ``STALE`` times or a text has a size that none had before (at most ``LARGE`` times; ``sizes`` names
    sizes to expect).

    ``carry``: columns kept with every record, for the condition of ``ingest``.
    """

    def __init__(self, spark: SparkSession, path: str, t: float = SIMILARITY, carry: tuple[str, ...] = (), sizes: tuple[int, ...] = ()):
        self.spark, self.path, self.t, self.carry, self.sizes = spark, path.rstrip("/"), t, carry, sizes
        self._versions = Versions(spark, self.path, "manifest")

    def manifest(self) -> tuple[int, dict]:
        n, m = self._versions.read()
        return n, m or {"runs": [], "next": 0, "order": None, "sizes": sorted(self.sizes), "ordered_at": 0}

    def _order(self, m: dict, frequent: dict[str, int], sizes: list[int], classes: int) -> None:
        at = f"order/v={m['next']}"
        words = pd.DataFrame({"w": list(frequent), "k": list(frequent.values())}, dtype=object)
        self.spark.createDataFrame(words, "w string, k long").write.mode("overwrite").parquet(f"{self.path}/{at}")
        m |= {"order": at, "sizes": sizes, "ordered_at": classes}

    def _frequent(self, m: dict) -> dict[str, int]:
        got = self.spark.read.parquet(f"{self.path}/{m['order']}").toPandas()
        return dict(zip(got["w"], got["k"].astype(int), strict=True))

    # --- runs

    def _paths(self, kind: str, m: dict, touched: set[int] | None, most_bits: int) -> list[str]:
        out = []
        for r in m["runs"]:
            bits, there = r["bits"][kind], r["ranges"][kind]
            want = there if touched is None else sorted({x >> most_bits - bits for x in touched} & set(there))
            out += [f"{self.path}/{kind}/run={r['id']}/range={x}" for x in want]
        return out

    def _read(self, kind: str, m: dict, near: DataFrame | None = None, column: str = "") -> DataFrame | None:
        """The stored rows of the ranges that ``column`` of ``near`` touches, or all."""
        bits = max((r["bits"][kind] for r in m["runs"]), default=0)
        touched = None
        if near is not None:  # no more numbers than there are ranges
            touched = {r[0] for r in near.select(range_of(column, bits)).distinct().collect()}
        paths = self._paths(kind, m, touched, bits)
        if near is not None:
            self.last_read.setdefault(kind, []).extend(paths)
        return self.spark.read.parquet(*paths) if paths else None

    def _store(self, run: dict, kind: str, rows: DataFrame, by: str, n: int) -> DataFrame:
        """Write the rows of a run, about ``n``, by range and sorted within; returns what is written."""
        bits = max(0, math.ceil(math.log2(max(1, n / RANGE_ROWS))))
        out = rows.withColumn("range", range_of(by, bits))
        out = out.repartition(2**bits, "range") if bits else out
        path = f"{self.path}/{kind}/run={run['id']}"
        out.sortWithinPartitions("range", by).write.mode("overwrite").partitionBy("range").parquet(path)
        names = [s.getPath().getName() for s in self._versions.fs.listStatus(self._versions.at(f"{kind}/run={run['id']}"))]
        there = sorted(int(x.removeprefix("range=")) for x in names if x.startswith("range="))
        run["bits"][kind], run["ranges"][kind] = bits, there
        return self.spark.read.parquet(*[f"{path}/range={x}" for x in there]) if there else rows.where("false")

    def _new_run(self, m: dict, tier: int) -> dict:
        m["next"] += 1
        return {"id": m["next"] - 1, "tier": tier, "bits": {}, "ranges": {}}

    def ingest(
        self, batch: DataFrame, ident: str = "id", text: str = "content", wanted: str | None = "true", within: bool = False, distinct: bool = True
    ) -> DataFrame | None:
        """(id, match_id, similarity): each record of the batch with its (near-)copies among all accepted records.

        The batch is then accepted as a run of its own.  ``wanted``: a condition on the carried columns of the new record and, with
        ``old_`` before their names, of its counterpart; None accepts the batch without comparing it.  ``within``: compare the
        batch's records with each other as well, each pair once.  Ids repeated count once (``distinct``: they are looked
        for); a batch without usable text changes nothing.
        """
        number, m = self.manifest()
        self.last_read: dict[str, list[str]] = {}
        full = word_classes(batch.dropDuplicates([ident]) if distinct else batch, text, ident, *self.carry).withColumnRenamed(ident, "id")
        rows, classes = full.drop("words"), full.groupBy("cls").agg(F.any_value("h").alias("h"), F.any_value("words").alias("words")).select("h", "cls", "words")
        if wanted is not None:
            rows, classes = cut(rows), cut(classes)
        n, run = batch.count(), self._new_run(m, 0)
        stored, fresh, known = self._read("classes", m, rows, "h"), classes, None
        if stored is not None:  # a class that is known needs no keys again
            known = cut(rows.select("h", "cls").distinct().join(stored.select("h", "cls"), ["h", "cls"], "left_semi"))
            fresh = fresh.join(maybe_broadcast(known), ["h", "cls"], "left_anti")
        fresh = self._store(run, "classes", fresh, "h", n)
        self._fit(m, full, fresh)
        found, keys = None, None
        if wanted is not None:
            keys = cut(keyed(classes, self._frequent(m), m["sizes"], self.t))
            found = self._compare(m, rows, classes, fresh, keys, wanted, within)
        if rows.isEmpty():
            return found
        if keys is None:
            keys = keyed(fresh, self._frequent(m), m["sizes"], self.t)
        elif known is not None:
            keys = keys.join(maybe_broadcast(known.select("h")), "h", "left_anti")
        self._store(run, "keys", keys.select("h", "key", "meta"), "key", n * KEYS)
        self._store(run, "members", rows.select("h", "cls", "id", *self.carry), "h", n)
        m["runs"].append(run | {"classes": fresh.count()})
        self._compact(m)
        self._versions.write(number, m)
        return found

    def _fit(self, m: dict, full: DataFrame, fresh: DataFrame) -> None:
        """Make or renew the word order where the batch needs it."""
        known = sum(r["classes"] for r in m["runs"])
        new = set(sizes_of(full)) - set(m["sizes"])
        if m["order"] is not None and not new and known < STALE * max(m["ordered_at"], 1000):
            return
        old = self._read("classes", m)
        every = fresh if old is None else old.select("h", "cls", "words").unionByName(fresh.select("h", "cls", "words"))
        self._order(m, frequent_words(every), sorted({*m["sizes"], *new}), every.count())
        if m["runs"]:
            self._merge(m, m["runs"], max(r["tier"] for r in m["runs"]), rekey=True)

    def _compare(self, m: dict, rows: DataFrame, classes: DataFrame, fresh: DataFrame, keys: DataFrame, wanted: str, within: bool) -> DataFrame:
        carried = [F.col(c).alias(f"old_{c}") for c in self.carry]
        old_keys = self._read("keys", m, keys, "key")
        none = keys.select(F.col("h").alias("a"), F.col("h").alias("b")).where("false")
        pairs = none if old_keys is None else windows(keys, old_keys.select("h", "key", "meta"), self.t)
        if within:
            pairs = pairs.unionByName(windows(keys, keys, self.t).where("a < b")).distinct()
        pairs = cut(pairs)
        words, members = maybe_broadcast(classes), rows.select("h", "cls", F.col("id").alias("match_id"), *carried, F.lit(True).alias("own"))
        theirs = pairs.select(F.col("b").alias("h")).distinct()
        old_words = self._read("classes", m, theirs, "h")
        right = fresh.select("h", "cls", "words")  # those of the batch that are not stored
        if old_words is not None:
            right = right.unionByName(old_words.select("h", "cls", "words"))
        near = cut(verify(pairs, words, right, self.t))
        linked = near.unionByName(classes.select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(1.0).alias("similarity")))
        linked = linked.withColumn("h", F.xxhash64("b"))
        old_members = self._read("members", m, linked, "h")
        sides = members if within else members.where("false")
        if old_members is not None:
            sides = sides.unionByName(old_members.select("h", "cls", F.col("id").alias("match_id"), *carried, F.lit(False).alias("own")))
        new_side = rows.select(F.col("cls").alias("a"), "id", *self.carry)
        hit = linked.drop("h").join(new_side, "a").join(sides.drop("h").withColumnRenamed("cls", "b"), "b")
        # of two records of the batch with one word set only one order counts
        hit = hit.where("id <> match_id and not (own and a = b and id > match_id)").where(wanted)
        return cut(hit.select("id", "match_id", "similarity").distinct())

    # --- compaction

    def _merge(self, m: dict, runs: list[dict], tier: int, rekey: bool = False) -> None:
        part, run, n = {**m, "runs": runs}, self._new_run(m, tier), sum(r["classes"] for r in runs)
        classes = self._store(run, "classes", self._read("classes", part).select("h", "cls", "words").dropDuplicates(["cls"]), "h", n)
        members = self._read("members", part).select("h", "cls", "id", *self.carry).dropDuplicates(["id", "cls"])
        keys = keyed(classes, self._frequent(m), m["sizes"], self.t) if rekey else self._read("keys", part).select("h", "key", "meta").distinct()
        self._store(run, "keys", keys, "key", n * KEYS)
        self._store(run, "members", members, "h", n)
        gone = {r["id"] for r in runs}
        m["runs"] = [r for r in m["runs"] if r["id"] not in gone] + [run | {"classes": n}]
        m.setdefault("gone", []).extend(gone)

    def _compact(self, m: dict) -> None:
        """Merge ``FAN`` runs of a size into one of the next; files that the version before needed are removed."""
        for k in m.pop("gone", []):
            for kind in ("classes", "members", "keys"):
                self._versions.fs.delete(self._versions.at(f"{kind}/run={k}"), True)
        tier = 0
        while tier <= max((r["tier"] for r in m["runs"]), default=-1):
            same = [r for r in m["runs"] if r["tier"] == tier]
            if len(same) >= FAN:
                self._merge(m, same, tier + 1)
            tier += 1

    def drop(self) -> None:
        """Remove the folder."""
        self._versions.fs.delete(self._versions.at(""), True)


def memory_repeats(memories: DataFrame, t: float = SIMILARITY, batches: int = BATCHES) -> DataFrame:
    """(id_a, id_b): raw memories and the reviewed ones, or raw ones of another day, with nearly the same words.

    The reviewed memories are the accepted history; the raw ones come in order, in ``batches`` of consecutive days, each compared with the
    runs of all before and, day against day, with itself.  The result is that of one batch per day.  Rows repeated
    under one id count once.  A raw memory without timestamp lies on no known day, so it is compared with reviewed
    memories only.  Null and wordless contents equal nothing.
    """
    spark = memories.sparkSession
    folder = f"{shared_dir(spark)}/runs-{uuid4().hex}"
    m = memories.select(F.col("id").cast("string").alias("id"), "content", clean(F.col("status")).alias("st"), F.to_date("timestamp").cast("string").alias("day"))
    m = m.where("st in ('raw', 'reviewed') and id is not null")
    days = m.where("st = 'raw' and day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    share = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)) / F.sum("n").over(Window.partitionBy())
    turn = days.select("day", F.least(F.lit(batches - 1), F.floor(F.coalesce(share, F.lit(0.0)) * batches)).cast("int").alias("turn"))
    m = m.dropDuplicates(["id"]).join(maybe_broadcast(turn), "day", "left")
    m = m.withColumn("turn", F.when(F.col("st") == "raw", F.coalesce("turn", F.lit(batches - 1))).otherwise(-1))
    kept = "id string, content string, st string, day string, turn int"
    m.select("id", "content", "st", "day", "turn").write.partitionBy("turn").parquet(f"{folder}/in")
    m = spark.read.schema(kept).parquet(f"{folder}/in")
    runs = SortedRuns(spark, folder, t, ("st", "day"), tuple(sizes_of(word_classes(m, "content"))))
    try:
        runs.ingest(m.where("turn = -1"), wanted=None, distinct=False)
        found = []
        for k in range(batches):
            found.append(runs.ingest(m.where(F.col("turn") == k), wanted="old_st = 'reviewed' or day <> old_day", within=True, distinct=False))
        every = found[0]
        for x in found[1:]:
            every = every.unionByName(x)
        return every.select(F.least("id", "match_id").alias("id_a"), F.greatest("id", "match_id").alias("id_b"))
    finally:
        runs.drop()
