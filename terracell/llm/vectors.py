"""Near-duplicate vectors by int8 tile products with exact error bounds.

Equal vectors of a label are folded into one first.  The rest of a label is dealt into
blocks by hash, and every pair of blocks is a tile: one task multiplies the int8 codes of
two blocks, adds what rounding can have hidden, and only pairs that may reach the
threshold are computed again in double precision.  A tile gives per vector the number of
its links, and a spanning forest of them, never the pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.llm.graph import components
from terracell.llm.registry import query, read
from terracell.llm.store import checkpointed, columns, written

THRESHOLD = 0.93
BLOCK = 4096  # rows of a block; a tile holds two
STRIPE = 512  # rows of one product inside a tile


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, key1, key2, raw): raw is the vector's bytes, null where it links with nothing."""

    def run(batches):
        for batch in batches:
            raw, key1, key2 = [], [], []
            column = batch.column("embedding")
            for k in range(batch.num_rows):
                item = column[k]
                data = None
                if item.is_valid and item.values.null_count == 0 and len(item.values):
                    x = item.values.to_numpy(zero_copy_only=False).astype("<f8")
                    if np.isfinite(x).all() and x.any():
                        data = (x + 0.0).tobytes()  # -0.0 is 0.0
                digest = hashlib.blake2b(data, digest_size=16).digest() if data is not None else bytes(16)
                raw.append(data)
                key1.append(int.from_bytes(digest[:8], "little", signed=True))
                key2.append(int.from_bytes(digest[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(raw, pa.binary())],
                ["vec_id", "label", "key1", "key2", "raw"],
            )

    return columns(vectors, vec_id="long", label="int", embedding="array<double>").mapInArrow(
        run, "vec_id long, label int, key1 long, key2 long, raw binary"
    )


def _codes(x: np.ndarray):
    """Unit vectors, their int8 codes (as floats that hold them exactly), scales, rounding errors."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return unit, codes, scale, error


def _candidates(a, b, threshold: float):
    """Index pairs that may reach the threshold, from the codes alone.

    With u = s q + r, |r| = e: u.v = s t q.p + r.v + (u - r).w, so the product of codes is
    off by at most e_u + (1 + e_u) e_v.  Sums of at most 1,000 int8 products are whole
    numbers below 2**24, so single precision holds them exactly; longer vectors are
    summed in parts.
    """
    _, qa, sa, ea = a
    _, qb, sb, eb = b
    total = np.zeros((len(qa), len(qb)))
    for k in range(0, qa.shape[1], 1000):
        total += qa[:, k : k + 1000].astype(np.float32) @ qb[:, k : k + 1000].astype(np.float32).T
    total *= sa[:, None] * sb[None, :]
    total += ea[:, None] + (1 + ea[:, None]) * eb[None, :] + 1e-9
    return np.nonzero(total >= threshold)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; each set points to its lowest member."""
    while True:
        parent = _roots(parent)
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def tile_links(x: np.ndarray, y: np.ndarray | None, weights: np.ndarray, threshold: float):
    """(links of each row, lowest row it is joined to) within a tile.

    The rows are those of ``x``, then those of ``y``; with ``y`` None all pairs inside
    ``x``, else the pairs between both.
    """
    n = len(x)
    rows = x if y is None else np.concatenate([x, y])
    unit, codes, scale, error = _codes(rows)
    counts, parent = np.zeros(len(rows), np.int64), np.arange(len(rows))
    part = lambda a, b: (unit[a:b], codes[a:b], scale[a:b], error[a:b])
    for i in range(0, n, STRIPE):
        for j in range(i if y is None else n, n if y is None else len(rows), STRIPE):
            top, side = min(i + STRIPE, n), min(j + STRIPE, n if y is None else len(rows))
            a, b = _candidates(part(i, top), part(j, side), threshold)
            a, b = a + i, b + j
            if y is None:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 200_000):
                u, v = a[k : k + 200_000], b[k : k + 200_000]
                hit = np.einsum("ij,ij->i", unit[u], unit[v]) >= threshold
                u, v = u[hit], v[hit]
                counts += np.bincount(u, weights[v], len(rows)).astype(np.int64)
                counts += np.bincount(v, weights[u], len(rows)).astype(np.int64)
                parent = _merge(parent, u, v)
    return counts, parent


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy()
        order = np.argsort(~first, kind="stable")
        table, first = table.take(pa.array(order)), first[order]
        raw, dims = table.column("raw").to_pylist(), None
        size = np.array([len(r) // 8 for r in raw])
        rep, key, weight = (table.column(c).to_numpy() for c in ("rep", "key1", "weight"))
        inner = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        out = []
        for dims in np.unique(size):  # vectors of other lengths have no cosine
            own = np.flatnonzero(size == dims)
            rows = np.frombuffer(b"".join(raw[k] for k in own), "<f8").reshape(-1, dims)
            n = int(first[own].sum())
            if inner:
                counts, parent = tile_links(rows, None, weight[own], threshold)
            else:
                counts, parent = tile_links(rows[:n], rows[n:], weight[own], threshold)
            keep = np.flatnonzero(counts)
            out.append((rep[own][keep], key[own][keep], counts[keep], rep[own][parent[keep]]))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out)]
        label = pa.array([table.column("label")[0].as_py()] * len(cols[0]), pa.int32())
        return pa.table([label, *map(pa.array, cols)], names=["label", "rep", "key1", "links", "root"])

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, label)``.

    Two vectors link when their labels are equal and not null and their cosine in double
    precision is at least ``threshold``.  A vector that is null, empty or zero or holds a
    null or a number that isn't finite links with nothing, nor does one with a null label
    or another length.  Repeated rows count as vectors of their own (with one id they are
    one node of the graph).  A row with a null vec_id links with nothing and isn't kept.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = written(prepared(vectors), "vectors")
    usable = rows.where("raw IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    folded = usable.groupBy("label", "key1", "key2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("raw").alias("raw")
    )
    folded = written(folded, "folded")
    blocks = folded.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = folded.join(blocks, "label").withColumn("own", F.pmod(F.col("key2"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "label",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("first"),
        "rep",
        "key1",
        "weight",
        "raw",
    )
    found = checkpointed(
        tiles.groupBy("label", "i", "j").applyInArrow(_tile(threshold), "label int, rep long, key1 long, links long, root long")
    )
    # Copies of one vector are linked, and joined under the lowest of their ids.
    links = found.groupBy("label", "rep", "key1").agg(F.sum("links").alias("links"))
    # An id on rows with different vectors is one node: it is tied to the first of each.
    met = usable.select("label", "key1", "key2", "vec_id").distinct()
    repeated = met.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    tied = met.join(repeated, "vec_id").join(folded.select("label", "key1", "key2", "rep"), ["label", "key1", "key2"])
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(tied.select("rep", "vec_id"))
    joined = components(edges)
    reps = (
        folded.select("label", "key1", "key2", "rep", "weight")
        .join(links, ["label", "rep", "key1"], "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label",
            "key1",
            "key2",
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    known = F.col("vec_id").isNotNull() & F.col("raw").isNotNull()
    out = rows.join(reps, ["label", "key1", "key2"], "left")
    return out.select(
        "vec_id",
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(known, F.coalesce("component", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL),
l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id
      AND list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id n, vec_id c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
m AS (SELECT n, min(c) c FROM r GROUP BY n),
k AS (SELECT a, count(*) n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n, 0) n_links, coalesce(m.c, e.vec_id) component_id,
       e.vec_id = coalesce(m.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN m ON m.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""


@query("op5_vectors", SQL)
def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read(spark, sf_dir, "embeddings"))
