"""Set-similarity join of documents on word shingles, exact, by partitions of the universe.

Two sets of Jaccard similarity t differ in at most (1 - t) / (1 + t) of their sizes' sum.
Shingles are hashed into more segments than that, so two such sets agree in a whole
segment; where a set's size makes segments too small to tell sets apart, fewer segments are
taken and some also indexed with each one shingle left out (they then stand for two
differences).  How many of each is decided per band of sizes by the cost in index rows.
An empty segment tells nothing and isn't indexed: a set with too few others is indexed
again under further partitions, until one has enough of them.  Of two similar sets, the one
that stops first has enough segments in a partition that both have, so no pair is lost.

What shares an index row is verified exactly: first against the smallest set of the row,
which settles groups of copies in one pass, then, where sets of a row are still apart, pair
by pair in rows of few sets and in tiles of bounded size in the others.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terracell.llm.graph import components
from terracell.llm.registry import query, read
from terracell.llm.store import Scratch, checkpointed, columns, free, fresh, same_columns, shuffled, written
from terracell.llm.vectors import _merge
from terracell.llm.words import chunks, mix, shingle_sets

WORDS = 5
#: Similar means 100 * common >= 80 * all.
PERCENT = 80
BAND_RATIO = 1.6
LEAST_SEGMENT, SPARE = 2.0, 1.12
STAR, TILE = 512, 512
#: Pairs under keys of so many sets are listed; larger keys are taken in tiles.
FEW = 32
#: Places of a set's parities.
MARKS = 2048
MAX_SEEN = 500_000

_ONE = np.uint64(0x9E3779B97F4A7C15)


def similar(common, a, b):
    return 100 * common >= PERCENT * (a + b - common)


def largest_partner(size: int) -> int:
    return 100 * size // PERCENT


def most_apart(a: int, b: int) -> int:
    """The largest symmetric difference of similar sets of these sizes."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


@lru_cache(maxsize=None)
def band(k: int) -> tuple[int, int]:
    """Smallest and largest size of a band."""
    low = 1
    for _ in range(k):
        low = max(low + 1, math.ceil(low * BAND_RATIO))
    return low, max(low + 1, math.ceil(low * BAND_RATIO)) - 1


@lru_cache(maxsize=100_000)
def band_of(size: int) -> int:
    k = 0
    while band(k)[1] < size:
        k += 1
    return k


@lru_cache(maxsize=None)
def allocation(k: int) -> tuple[int, int]:
    """Segments of a band, and how many of them are also indexed with one shingle left out."""
    low, high = band(k)
    need = most_apart(high, largest_partner(high)) + 1
    best = None
    for left_out in range(need + 1):
        segments = max(math.ceil(SPARE * need) - left_out if need > 1 else 1, left_out, 1)
        if segments > 1 and low / segments < LEAST_SEGMENT:
            continue
        cost = segments + left_out * (low + high) / 2 / segments
        if best is None or cost < best[0]:
            best = (cost, segments, left_out)
    return best[1], best[2]


def _sums(place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit numbers by place, modulo 2**64; halves of 32 bits add up exactly as floats."""
    low = np.bincount(place, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(place, (value >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def index_keys(shingles: np.ndarray) -> list[tuple[bool, int, np.ndarray]]:
    """(lower, least, keys) of one set for its own band and, where it reaches there, the one below.

    ``least`` is the number of its keys that a similar set of the band shares at least: of
    its full segments, so many as can differ are taken off.
    """
    size = len(shingles)
    own = band_of(size)
    out = []
    value = mix(shingles ^ _ONE)
    for k in (own - 1, own):
        if k < 0 or (k < own and size > largest_partner(band(k)[1])):
            continue
        apart = most_apart(size, band(k)[1]) if k < own else most_apart(size, largest_partner(size))
        segments, left_out = allocation(k)
        keys, seed = [], 0
        while True:
            salt = mix(np.array([k << 32 | seed], np.uint64))[0]
            place = (mix(value ^ salt) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
            place = place.astype(np.int64)
            counts = np.bincount(place, minlength=segments)
            sums = _sums(place, value, segments)
            full = np.flatnonzero(counts)
            names = mix(np.arange(segments, dtype=np.uint64) + salt)
            keys.append(mix(sums[full] ^ names[full]))
            if left_out:
                some = np.flatnonzero((place < left_out) & (counts[place] > 1))
                keys.append(mix((sums[place[some]] - value[some]) ^ names[place[some]]))
            if len(full) + int((counts[:left_out] > 1).sum()) > apart:
                break
            seed += 1
        least = len(full) - apart if not left_out and not seed else 1
        out.append((k < own, max(least, 1), np.concatenate(keys)))
    return out


def _node(shingles: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets share it."""
    return int(mix(np.array([mix(shingles ^ np.uint64(77)).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def shingle_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, node): the size of each row's set and its name, null when it's empty.

    ``row`` is the hash of the text as it is, to tell rows with one id apart.
    """

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                rows = [(len(s), _node(s) if len(s) else None) for s in shingle_sets(part.column("text"), WORDS)]
                n, node = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array(n, pa.int64()), pa.array(node, pa.int64())],
                    ["doc_id", "row", "n_shingles", "node"],
                )

    texts = columns(docs, doc_id="long", text="string").withColumn("row", F.xxhash64("text"))
    return texts.mapInArrow(run, "doc_id long, row long, n_shingles long, node long")


def _once(batches):
    """(node, set) of the non-empty texts; a set met again lately in this task is left out."""
    seen: set[int] = set()
    for batch in batches:
        for part in chunks(batch):
            for own in shingle_sets(part.column("text"), WORDS):
                if len(own) and (node := _node(own)) not in seen:
                    if len(seen) >= MAX_SEEN:
                        seen.clear()
                    seen.add(node)
                    yield node, own


def index_rows(docs: DataFrame) -> DataFrame:
    """(key, node, info): the index; copies within a task are folded before the shuffle.

    ``info`` has the set's size, whether the band is the lower one, and the least number of
    keys shared with a similar set, in 31, 1 and 31 bits.
    """

    def run(batches):
        keys, nodes, infos, n = [], [], [], 0

        def flushed():
            counts = [len(k) for k in keys]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.repeat(np.array(nodes, np.int64), counts)),
                    pa.array(np.repeat(np.array(infos, np.int64), counts)),
                ],
                ["key", "node", "info"],
            )

        for node, own in _once(batches):
            for lower, least, found in index_keys(own):
                keys.append(found)
                nodes.append(node)
                infos.append(len(own) << 32 | lower << 31 | least)
                n += len(found)
            if n > 200_000:
                yield flushed()
                keys, nodes, infos, n = [], [], [], 0
        if n:
            yield flushed()

    return columns(docs, text="string").mapInArrow(run, "key long, node long, info long")


def shared_rows(index: DataFrame) -> DataFrame:
    """(key, node, size, hub) of the index rows whose key several sets have.

    A set that shares fewer keys than it must with any similar set has none: its rows go,
    in two rounds, as groups shrink by what the round before took out.
    """
    of = Window.partitionBy("key")

    def kept(rows: DataFrame) -> DataFrame:
        ends = {"low": F.min("node").over(of), "high": F.max("node").over(of)}
        return rows.withColumns(ends).where("low != high").select("key", "node", "info")

    rows = written(kept(index), "shared-keys")
    for _ in range(2):
        enough = (
            rows.groupBy("node", "info")
            .agg(F.count("*").alias("n"))
            .where(F.col("n") >= F.col("info").bitwiseAND((1 << 31) - 1))
            .select("node", "info")
        )
        old, rows = rows, written(kept(rows.join(shuffled(enough), ["node", "info"])), "shared-keys")
        free(old)
    sized = rows.select("key", "node", F.shiftright("info", 32).alias("size"))
    return sized.withColumn("hub", F.min(F.struct("size", "node")).over(of))


def _shingled(texts: DataFrame) -> DataFrame:
    """(node, shingles) with the sorted hashes as bytes, of the texts whose set has the name asked for."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                found = list(shingle_sets(part.column("text"), WORDS))
                asked = part.column("node").to_pylist()
                keep = [i for i, s in enumerate(found) if len(s) and (asked[i] is None or _node(s) == asked[i])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_node(found[i]) for i in keep], pa.int64()),
                        pa.array([found[i].tobytes() for i in keep], pa.binary()),
                    ],
                    ["node", "shingles"],
                )

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def needed_sets(docs: DataFrame, named: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ``needed``, each once."""
    texts = columns(docs, doc_id="long", text="string")
    needed = shuffled(needed)
    first = named.where("doc_id IS NOT NULL").join(needed, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    with_id = texts.join(shuffled(first), "doc_id").select("node", "text")
    # Rows without an id can't be asked for by it.
    without = texts.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("node"), "text")
    return _shingled(with_id.union(without)).join(needed, "node", "left_semi").dropDuplicates(["node"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def parities(sets: DataFrame) -> DataFrame:
    """(node, n, marks): size of each set and, for each of ``MARKS`` places its shingles hash to, whether their number is odd."""

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
            marks = []
            for own in found:
                place = (mix(own ^ np.uint64(5)) % np.uint64(MARKS)).astype(np.int64)
                marks.append(np.packbits(np.bincount(place, minlength=MARKS).astype(np.uint8) & 1).tobytes())
            n = pa.array([len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), n, pa.array(marks, pa.binary())], ["node", "n", "marks"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, n long, marks binary")


def sifted(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (hub, member) that may be similar by their ``parities``.

    A shingle that only one of two sets has turns one mark, so the marks that differ are
    never more than the shingles that do: no similar pair is lost, and of the others
    few move their sets.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MARKS // 8) for c in ("_a", "_b"))
            sizes = batch.column("_n").to_numpy() + batch.column("n").to_numpy()
            near = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= most_apart(sizes, 0)
            yield batch.select(["hub", "member"]).filter(pa.array(near))

    a = marks.select(F.col("node").alias("hub"), F.col("n").alias("_n"), F.col("marks").alias("_a"))
    b = marks.select(F.col("node").alias("member"), "n", F.col("marks").alias("_b"))
    met = pairs.join(shuffled(a), "hub").join(shuffled(b), "member")
    return met.select("hub", "member", "_n", "n", "_a", "_b").mapInArrow(run, "hub long, member long")


def _star(table: pa.Table) -> pa.Table:
    """Links between the first set of a group and the others."""
    member = table.column("member").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    hub, own = table.column("hub")[0].as_py(), sets[member.index(None)]
    linked = [m for m, s in zip(member, sets) if m is not None and similar(_common(own, s), len(own), len(s))]
    return pa.table([pa.array([hub] * len(linked), pa.int64()), pa.array(linked, pa.int64())], names=["a", "b"])


def verified_stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among distinct pairs (hub, member); a hub with many members is dealt to many tasks."""
    many = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    dealt = pairs.join(shuffled(many), "hub").select("hub", "member", F.pmod(F.xxhash64("member"), F.col("parts")).alias("part"))
    dealt, sets = checkpointed(dealt), shuffled(sets)
    members = dealt.join(sets, dealt.member == sets.node).select("hub", "part", "member", "shingles")
    heads = dealt.select("hub", "part").distinct()
    hubs = heads.join(sets, heads.hub == sets.node).select("hub", "part", F.lit(None).cast("long").alias("member"), "shingles")
    return hubs.union(members).groupBy("hub", "part").applyInArrow(lambda t: _star(t), "a long, b long")


def _tile(table: pa.Table) -> pa.Table:
    """Links of a tile, as a spanning forest: pairs of sets in different components."""
    table = table.sort_by("first")
    node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
    first = table.column("first").to_numpy()
    inner = table.column("i")[0].as_py() == table.column("j")[0].as_py()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    begins = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    lens = np.diff(np.append(begins, len(values)))
    group = np.repeat(np.arange(len(begins)), lens)
    by_owner = np.argsort(owners, kind="stable")
    cuts = np.searchsorted(owners[by_owner], np.arange(len(sets) + 1))
    parent = np.arange(len(sets))
    for k in range(len(sets)):
        groups = group[by_owner[cuts[k] : cuts[k + 1]]]
        groups = groups[lens[groups] > 1]
        if not len(groups):
            continue
        steps = lens[groups]
        at = np.repeat(begins[groups] - np.append(0, np.cumsum(steps)[:-1]), steps) + np.arange(steps.sum())
        common = np.bincount(owners[at], minlength=len(sets))
        hit = similar(common, sizes, sizes[k]) & (component != component[k])
        if not inner:
            hit &= first != first[k]
        others = np.flatnonzero(hit)
        parent = _merge(parent, np.full(len(others), k), others)
    tied = np.flatnonzero(parent != np.arange(len(sets)))
    return pa.table([pa.array(node[parent[tied]]), pa.array(node[tied])], names=["a", "b"])


def open_rows(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, node, size, component, n, least) of the sets whose pairs under a shared key are not all settled.

    The star of a key has compared its hub with all others, so a key is open where its ``n``
    other sets lie in several components; ``least`` is the smallest of them.  Keys that are
    not open have nothing left to find.
    """
    of = Window.partitionBy("key")
    others = shared.where(F.col("hub.node") != F.col("node")).select("key", "node", "size").distinct()
    others = others.join(shuffled(joined), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = {"low": F.min("component").over(of), "high": F.max("component").over(of)}
    ends |= {"least": F.min("node").over(of), "n": F.count("*").over(of)}
    return others.withColumns(ends).where("low != high").select("key", "node", "size", "component", "n", "least")


def open_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs (hub, member) of ``open_rows`` under keys of few sets, in different components.

    Pairs under such keys grow with the index rows; the families that these keys tie
    together would hold more and more of a growing table, and tiles of a family grow with its square.
    """
    few = rows.where(F.col("n") <= FEW)
    a = few.select("key", *[F.col(c).alias(f"_{c}") for c in ("node", "size", "component")])
    pairs = a.join(shuffled(few), "key").where((F.col("_node") < F.col("node")) & (F.col("_component") != F.col("component")))
    least, most = F.least("_size", "size"), F.greatest("_size", "size")
    return pairs.where(similar(least, least, most)).select(F.col("_node").alias("hub"), F.col("node").alias("member")).distinct()


def _unsettled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """(family, node, component, n) of the families that still hold several components.

    A family is what open keys of many sets connect, so every pair under them lies in one.
    """
    many = rows.where(F.col("n") > FEW)
    families = components(many.select(F.col("least").alias("a"), F.col("node").alias("b")))
    labelled = checkpointed(
        families.withColumnRenamed("component", "family")
        .join(shuffled(joined), "node", "left")
        .select("family", "node", F.coalesce("component", "node").alias("component"))
    )
    open_ = labelled.groupBy("family").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    return labelled.join(shuffled(open_.where("low != high").select("family", "n")), "family")


def verified_tiles(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the sets of each family (family, node, component, n), in tiles of two blocks at most."""
    dealt = groups.select(
        "family", "node", "component", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")
    ).withColumn("own", F.pmod(F.xxhash64("node", "family"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") <= F.col("other")).alias("first"), "node", "component",
    )
    return tiles.join(shuffled(sets), "node").groupBy("family", "i", "j").applyInArrow(lambda t: _tile(t), "a long, b long")


def labelled_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n_shingles, component) for each row; the component names a set, null for an empty one.

    Written to the shared folder; all that led to it is gone.
    """
    with Scratch() as scratch:
        named = written(shingle_counts(docs), "shingle-counts")
        shared = written(shared_rows(index_rows(docs)), "shared-keys")
        sets = written(needed_sets(docs, named, shared.select("node").distinct()), "shingle-sets")
        pairs = (
            shared.where(similar(F.col("hub.size"), F.col("hub.size"), F.col("size")) & (F.col("hub.node") != F.col("node")))
            .select(F.col("hub.node").alias("hub"), F.col("node").alias("member"))
            .distinct()
        )
        marks = written(parities(sets), "parities")
        links = checkpointed(verified_stars(sifted(pairs, marks), sets))
        joined = components(links)
        rows = written(open_rows(shared, joined), "open-keys")
        free(shared)
        few = checkpointed(verified_stars(sifted(open_pairs(rows), marks), sets))
        free(marks)
        many = checkpointed(verified_tiles(_unsettled(rows, joined), sets))
        free(rows)
        free(sets)
        joined = components(links.union(few).union(many))
        labelled = named.join(shuffled(joined), "node", "left").select(
            "doc_id", "row", "n_shingles", F.coalesce("component", "node").alias("component")
        )
        return scratch.keep(written(labelled, "labelled"))


def join_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``.

    Words are split at white space, A-Z lower-cased.  A set holds the distinct runs of five
    words, of a shorter text its whole sequence.  Documents link when their sets are
    similar; the component is the smallest doc_id that links reach.  A null, empty or blank
    text has an empty set, links with nothing and is its own component.  Rows with equal
    ids are each other's copies only if their texts are; a null doc_id takes part but never
    names a component (a component of nulls alone has none).  Other columns are ignored;
    an empty table gives no rows.
    """
    labelled = labelled_rows(docs)
    lowest = labelled.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("lowest"))
    return labelled.join(shuffled(lowest), "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component of ``join_documents``, all columns as they are.

    Rows are told apart by doc_id and text.  The smallest doc_id of a component stays, a
    null one only where there is no other; of several texts with that id, one.  Of rows
    with equal doc_id and text one stays, any of them where other columns differ.  Null,
    empty and blank texts all stay.  Columns may have any names; an empty table gives no rows.
    """
    labelled = labelled_rows(docs).where("component IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = labelled.groupBy("component").agg(F.min(place).alias("first"))
    later = labelled.join(shuffled(first), "component").where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")))
    )
    # What goes, and what is there more than once and stays once.
    again = labelled.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1")
    marks = later.select("doc_id", "row", F.lit(1).alias("mark")).union(again.select("doc_id", "row", F.lit(2)))
    marks = marks.groupBy("doc_id", "row").agg(F.min("mark").alias("mark"))
    i, r, m = fresh(docs, "id", "row", "mark")
    marks = marks.select(F.col("doc_id").alias(f"{i}2"), F.col("row").alias(f"{r}2"), F.col("mark").alias(m))
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), r: F.xxhash64(F.col("text").cast("string"))})
    same = F.col(i).eqNullSafe(F.col(f"{i}2")) & (F.col(r) == F.col(f"{r}2"))
    found = rows.join(shuffled(marks), same, "left")
    once = found.where(F.col(m) == 2).dropDuplicates([i, r])
    return found.where(F.col(m).isNull()).union(once).select(*same_columns(docs))


@query("op6_jaccard")
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(read(spark, sf_dir, "documents"))
