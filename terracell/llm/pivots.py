"""Exact top-k search by inner product over a pivot-distance index.

Each vector of whole numbers is keyed by its nearest pivot and its distance to it, and
the index keeps the rows of a pivot in annuli of about equal size.  From the distance of
a query to a pivot, the triangle inequality bounds the distance to all rows of an
annulus from below, hence the inner product from above:

    2 <q, c> = |q|^2 + |c|^2 - |q - c|^2 <= |q|^2 + (largest |c|^2) - (least distance)^2

A query opens its annuli in the order of these bounds, a few at first, then more, and
stops where no annulus left can reach the score of its k-th row so far.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terracell.llm.registry import query, read
from terracell.llm.store import checkpointed, columns, written

SCALE = 256
K = 5
PIVOTS = 64
SAMPLE = 4096  # rows that pivots are picked from
RING_ROWS = 512  # rows of an annulus, more when there are over MAX_RINGS of them
MAX_RINGS = 1 << 16  # annuli by size, besides one or two for each pivot: what a task holds of the index
QUERY_BLOCK = 1024  # queries that meet an annulus in one task
OPENED = (2, 16)  # annuli of the first rounds; the last opens all that can still count
STEPS = 64  # bins of distance for each doubling
LARGEST = 1 << 62  # squared norms stay below, so every score fits 64 bits


def coded(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, key, codes, norm2) of the vectors that take part; codes are 8-byte whole numbers."""

    def run(batches):
        for batch in batches:
            ids, keys, codes, norms = [], [], [], []
            names, column = batch.column("vec_id").to_pylist(), batch.column("embedding")
            for k, name in enumerate(names):
                item = column[k]
                if name is None or not item.is_valid or item.values.null_count or not len(item.values):
                    continue
                x = item.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                    if not (x * x).sum() < LARGEST / 4:  # far above what single rounding errors change
                        continue
                whole = x.astype("<i8")
                data = whole.tobytes()
                ids.append(name)
                keys.append(hashlib.blake2b(data, digest_size=16).digest())
                codes.append(data)
                norms.append(int(whole @ whole))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(codes, pa.binary()), pa.array(norms, pa.int64())],
                ["vec_id", "key", "codes", "norm2"],
            )

    return columns(vectors, vec_id="long", embedding="array<double>").mapInArrow(
        run, "vec_id long, key binary, codes binary, norm2 long"
    )


def picked(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Pivots by length: of ``sample`` rows with the smallest keys, each the farthest from those before it."""
    items = rows.select("key", "codes").orderBy("key").limit(sample).collect()
    by_length: dict[int, list[bytes]] = {}
    for item in items:
        by_length.setdefault(len(item.codes) // 8, []).append(bytes(item.codes))
    out = {}
    for length in sorted(by_length, key=lambda d: (-len(by_length[d]), d))[:pivots]:
        own = _floats(sorted(set(by_length[length])))
        most = max(1, pivots * len(by_length[length]) // len(items))
        chosen, far = [0], _distances(own, own[:1])[:, 0]
        while len(chosen) < min(most, len(own)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _distances(own, own[chosen[-1:]])[:, 0])
        out[length] = own[chosen]
    return out


def _floats(codes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(codes), "<i8").reshape(len(codes), -1).astype(np.float64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in y], axis=1))


def keyed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The rows with their pivot, its distance, and the bin of that distance.

    Pivots are numbered over all lengths.  Number -1 is the origin, for rows of a length
    that has no pivot.
    """
    first = {}
    for length in sorted(pivots):
        first[length] = sum(len(pivots[x]) for x in first)

    def run(batches):
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            size = np.array([len(c) // 8 for c in codes], np.int64)
            pivot, dist = np.full(len(codes), -1, np.int32), np.sqrt(batch.column("norm2").to_numpy().astype(np.float64))
            for length in np.unique(size):
                if length in pivots:
                    own = np.flatnonzero(size == length)
                    away = _distances(_floats([codes[k] for k in own]), pivots[length])
                    pivot[own] = first[length] + away.argmin(axis=1)
                    dist[own] = away.min(axis=1)
            bins = np.where(dist > 0, np.floor(np.log2(np.maximum(dist, 1e-9)) * STEPS), -10_000).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot), pa.array(dist), pa.array(bins)], [*batch.schema.names, "pivot", "dist", "bin"]
            )

    return rows.mapInArrow(run, "vec_id long, key binary, codes binary, norm2 long, pivot int, dist double, bin int")


def annuli(rows: DataFrame, ring_rows: int) -> DataFrame:
    """The rows with their annulus: neighbouring bins of a pivot together, large bins in parts by key."""
    counts = rows.groupBy("pivot", "bin").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pivot").orderBy("bin")) - F.col("n")  # a few thousand bins a pivot
    rings = counts.select(
        "pivot",
        "bin",
        F.floor(before / ring_rows).cast("int").alias("ring"),
        F.ceil(F.col("n") / ring_rows).cast("int").alias("pieces"),
    )
    part = F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")
    return rows.join(rings, ["pivot", "bin"]).withColumn("part", part).drop("pieces", "bin")


def _bounds(codes: np.ndarray, norm2: np.ndarray, rings: dict, pivots: dict, first: dict) -> np.ndarray:
    """Largest score that each query (of one length) may have in each annulus; -inf where there is none."""
    length = codes.shape[1]
    own = pivots.get(length)
    top = np.sqrt(norm2)[:, None] * np.sqrt(rings["norm2"])[None, :]
    fits = rings["pivot"] < 0
    if own is not None:
        away = _distances(codes, own)
        here = np.flatnonzero((rings["pivot"] >= first[length]) & (rings["pivot"] < first[length] + len(own)))
        to = away[:, rings["pivot"][here] - first[length]]
        # The nearest pivot of a row is the ring's own, so it lies at least half the difference away.
        least = np.maximum(to - rings["high"][here], rings["low"][here] - to)
        least = np.maximum(least, (to - away.min(axis=1, keepdims=True)) / 2)
        least = np.maximum(least * (1 - 1e-9) - 1e-6, 0)
        by_distance = (norm2[:, None] + rings["norm2"][None, here] - least**2) / 2
        top[:, here] = np.minimum(top[:, here], by_distance)
        fits[here] = True
    top = top + np.abs(top) * 1e-9 + 1  # above what rounding can hide
    top[:, ~fits] = -np.inf
    return top


def opened(queries: DataFrame, rings: dict, pivots: dict, begin: int, end: int | None) -> DataFrame:
    """(ring_id, key, codes, norm2, block, least): each query with its annuli ``begin`` to ``end`` by bound."""
    first = {}
    for length in sorted(pivots):
        first[length] = sum(len(pivots[x]) for x in first)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes = part.column("codes").to_pylist()
                size = np.array([len(c) // 8 for c in codes])
                norm2 = part.column("norm2").to_numpy().astype(np.float64)
                least = part.column("least").to_numpy()
                for length in np.unique(size):
                    own = np.flatnonzero(size == length)
                    top = _bounds(_floats([codes[k] for k in own]), norm2[own], rings, pivots, first)
                    order = np.argsort(-top, axis=1, kind="stable")[:, begin:end]
                    bound = np.take_along_axis(top, order, axis=1)
                    r, c = np.nonzero((bound >= least[own][:, None]) & np.isfinite(bound))
                    for k in range(0, len(r), 2000):
                        some = pa.array(own[r[k : k + 2000]])
                        rows = part.take(some)
                        yield pa.RecordBatch.from_arrays([pa.array(order[r[k : k + 2000], c[k : k + 2000]], pa.int64()), *rows.columns], ["ring_id", *rows.schema.names])

    return queries.mapInArrow(run, "ring_id long, key binary, codes binary, norm2 long, block int, least double")


def _products(x: list[bytes], y: list[bytes], exact: bool) -> np.ndarray:
    """Inner products in whole numbers; in double precision where every partial sum is a whole number below 2**53."""
    if exact:
        return (_floats(x) @ _floats(y).T).astype(np.int64)
    to = lambda codes: np.frombuffer(b"".join(codes), "<i8").reshape(len(codes), -1)
    return to(x) @ to(y).T


def _best(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        codes = table.column("codes").to_pylist()
        ids, norm2 = (table.column(c).to_numpy() for c in ("vec_id", "norm2"))
        least = table.column("least").to_numpy()
        size = np.array([len(c) for c in codes])
        rows, cols, scores = [], [], []
        for length in np.unique(size[asks]):
            q = np.flatnonzero(asks & (size == length))
            c = np.flatnonzero(~asks & (size == length))
            if not len(c):
                continue
            c = c[np.argsort(ids[c], kind="stable")]
            exact = math.sqrt(int(norm2[q].max())) * math.sqrt(int(norm2[c].max())) < 2**52
            held = [codes[i] for i in c]
            for at in range(0, len(q), 256):
                some = q[at : at + 256]
                found = _products([codes[i] for i in some], held, exact)
                floor = np.partition(found, -k, axis=1)[:, -k] if len(c) > k else np.full(len(some), -LARGEST)
                r, j = np.nonzero((found >= floor[:, None]) & (found >= least[some][:, None]))
                score = found[r, j]
                order = np.lexsort((j, -score, r))  # equal scores by vec_id
                r, j, score = r[order], j[order], score[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                r, j, score = r[place < k], j[place < k], score[place < k]
                rows.append(some[r])
                cols.append(c[j])
                scores.append(score)
        none = np.zeros(0, np.int64)
        r, j, s = (np.concatenate(x) if x else none for x in (rows, cols, scores))
        same = (s == norm2[r]) & (s == norm2[j])  # the inner product of equal vectors only
        keys = table.column("key")
        return pa.table(
            [keys.take(pa.array(r)).combine_chunks(), pa.array(ids[j], pa.int64()), pa.array(s, pa.int64()), pa.array(same)],
            names=["key", "vec_id", "score", "same"],
        )

    return run


def top_k(vectors: DataFrame, is_query: str, k: int = K, scale: int = SCALE, ring_rows: int = RING_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner products for each query row.

    ``vectors`` has (vec_id, embedding); ``is_query`` is a condition on vec_id in SQL.  A
    component x counts as floor(scale * x).  Every row is a candidate but the query's
    own; equal scores go to the smaller vec_id, ranks start at 1, and all rows are given
    where there are fewer than ``k``.

    Vectors take no part that are null or empty, hold a null or a number that isn't
    finite, have a null vec_id, or codes whose squares sum to 2**60 or more (a score
    might pass 64 bits).  Vectors of different lengths have no score.  Repeated rows are
    rows of their own: each is a candidate of the others and, as a query, has its own
    ranks.  Other columns are ignored; an empty table gives no rows.

    Of equal vectors only the ``k + 1`` with the smallest ids can be among a query's
    rows, so a vector of a third of the table costs no more than those.  Equal queries
    are answered once.  The rows of an annulus travel once for each block of
    ``QUERY_BLOCK`` queries that opens it.  Pivots are picked from ``SAMPLE`` rows.
    """
    rows = written(coded(vectors, scale), "codes")
    own = Window.partitionBy("key").orderBy("vec_id")
    kept = rows.withColumn("copy", F.row_number().over(own)).where(F.col("copy") <= k + 1).drop("copy")
    pivots = picked(kept)
    total = kept.count()
    index = annuli(written(keyed(kept, pivots), "keyed"), max(ring_rows, math.ceil(total / MAX_RINGS)))
    index = written(index.repartition("pivot", "ring", "part").sortWithinPartitions("pivot", "ring", "part", "dist"), "index")
    found = index.groupBy("pivot", "ring", "part").agg(
        F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm2").alias("norm2")
    )
    numbered = found.orderBy("pivot", "ring", "part").toPandas()  # bounded by MAX_RINGS, the parts and the pivots
    rings = {c: numbered[c].to_numpy() for c in ("pivot", "low", "high", "norm2")}
    spark = vectors.sparkSession
    names = spark.createDataFrame(
        [(i, *map(int, x)) for i, x in enumerate(numbered[["pivot", "ring", "part"]].itertuples(index=False))],
        "ring_id long, pivot int, ring int, part int",
    )
    index = index.join(F.broadcast(names), ["pivot", "ring", "part"])

    asked = rows.where(is_query)
    queries = asked.groupBy("key").agg(F.first("codes").alias("codes"), F.first("norm2").alias("norm2"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")), "queries")
    best = None
    for begin, end in zip((0, *OPENED), (*OPENED, None)):
        if best is None:
            least = queries.withColumn("least", F.lit(-math.inf))
        else:
            worst = best.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("score"))
            limit = F.when(F.col("n") > k, F.col("score").cast("double") - F.abs("score") * 1e-15)
            least = queries.join(worst, "key", "left").select(
                *queries.columns, F.coalesce(limit, F.lit(-math.inf)).alias("least")
            )
        asks = opened(least, rings, pivots, begin, end)
        wanted = asks.select("ring_id", "block").distinct()
        here = index.join(wanted, "ring_id").select(
            "ring_id", "block", F.lit(False).alias("asks"), "vec_id", "key", "codes", "norm2", F.lit(0.0).alias("least")
        )
        both = here.union(
            asks.select("ring_id", "block", F.lit(True), F.lit(0).cast("long"), "key", "codes", "norm2", "least")
        )
        new = both.groupBy("ring_id", "block").applyInArrow(_best(k + 1), "key binary, vec_id long, score long, same boolean")
        best = new if best is None else best.union(new)
        order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", F.desc("same"))
        best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
        best = checkpointed(best)
    lists = best.groupBy("key").agg(F.collect_list(F.struct("score", "vec_id", "same")).alias("all"))  # k + 1 at most
    # Its own row is one of the equal ones with its id; where it isn't in the list, it ranks after it.
    everyone = F.expr("array_sort(all, (x, y) -> CASE WHEN x.score != y.score THEN IF(x.score > y.score, -1, 1)"
                      " WHEN x.vec_id != y.vec_id THEN IF(x.vec_id < y.vec_id, -1, 1) WHEN x.same = y.same THEN 0 WHEN x.same THEN -1 ELSE 1 END)")
    me = F.expr("array_position(transform(all, x -> x.same AND x.vec_id = query_id), true)")
    rest = F.expr(f"slice(filter(all, (x, i) -> i + 1 != me), 1, {k})")
    out = asked.select(F.col("vec_id").alias("query_id"), "key").join(lists, "key")
    out = out.withColumn("all", everyone).withColumn("me", me).select("query_id", F.posexplode(rest).alias("place", "row"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "row.vec_id", "row.score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () k, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.k, q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) score
      FROM v q JOIN v c ON q.k != c.k AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


@query("op11_topk", SQL)
def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
