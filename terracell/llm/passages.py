"""Repeated passages: paragraphs by MinHash bands, verified, clustered and cut out.

Paragraphs are cut by content alone, so a passage gives the same ones wherever it stands:
they end at line ends and at most ends of sentences.  Equal
paragraphs meet by the name of their words; others through bands of MinHash values,
tuned for recall, with an exact check of each paragraph that shares a band against the
first of the band, then in tiles of bounded size of those still apart.  Components of what is alike keep their first occurrence; later ones
go where they add up to a run of enough words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from terracell.llm.graph import components
from terracell.llm.jaccard import PERCENT, verified_stars, verified_tiles
from terracell.llm.registry import query, read
from terracell.llm.store import Scratch, checkpointed, columns, fresh, same_columns, shuffled, written
from terracell.llm.words import chunks, mix, shingle_hashes, text_bytes, word_hashes

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99
UNLIKE, MET = 0.2, 0.2  # pairs of this similarity should meet no more often
LONG_SENTENCE, LONG_CUT = 16, 8  # beyond so many words a sentence is cut at one word in 8
RUN_WORDS = 20  # words in a row that must repeat for a removal
NO_ID = (1 << 63) - 1

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def tuned_bands(similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bands, values a band) that find a pair of this similarity often enough.

    The fewest bands in which a pair of similarity ``UNLIKE`` meets with a chance of at
    most ``MET``: bands of one value are fewer still, but every other pair would be checked.
    """
    options = [(max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**r))), r) for r in range(1, 6)]
    return min((b, r) for b, r in options if 1 - (1 - UNLIKE**r) ** b <= MET)


class Paragraphs:
    """The paragraphs of many texts: words ``first`` to ``last`` of ``hashes``, and the text of each.

    ``start`` and ``end`` are code points in the text, ``node`` names the sequence of words.
    """

    def __init__(self, texts: pa.Array):
        data, begins = text_bytes(texts)
        self.hashes, first, end, before = word_hashes(data, begins)
        n = len(self.hashes)
        self.last = self._ends(data, first, end, before) if n else np.zeros(0, np.int64)
        self.first = np.append(0, self.last[:-1] + 1)[: len(self.last)]
        self.text = np.searchsorted(before, self.first, side="right") - 1
        lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        base = lead[begins[self.text]]
        self.start, self.end = lead[first[self.first]] - base, lead[end[self.last]] - base
        self.words = self.last - self.first + 1
        self.place = np.arange(len(self.last)) - np.searchsorted(self.text, self.text)
        at = (np.arange(n) - np.repeat(self.first, self.words)).astype(np.uint64)
        value = mix(self.hashes + at * np.uint64(0x9E3779B97F4A7C15))
        self.node = mix(np.add.reduceat(value, self.first)).view(np.int64) if n else np.zeros(0, np.int64)

    def _ends(self, data, first, end, before) -> np.ndarray:
        """Words after which a paragraph ends: what is decided looks at that place alone.

        Line ends do, so do the ends of three sentences in four, as the hash of their last
        word picks, and in long sentences one word in eight.  No paragraph goes on into
        another text.
        """
        line = np.append(0, np.cumsum(data == 10))
        picked = self.hashes >> np.uint64(40)
        closing = _ENDS[data[end - 1]]
        paragraph = closing & (picked % np.uint64(4) != 0)
        line_end = np.zeros(len(first), bool)
        line_end[:-1] = line[first[1:]] > line[end[:-1]]
        line_end[before[1:][before[1:] > before[:-1]] - 1] = True
        ends = np.flatnonzero(closing | line_end)
        lens = np.diff(np.append(-1, ends))
        paragraph |= line_end | (picked % np.uint64(LONG_CUT) == 0) & np.repeat(lens > LONG_SENTENCE, lens)
        return np.flatnonzero(paragraph)

    def least(self, seeds: np.ndarray) -> np.ndarray:
        """For each seed and paragraph the smallest hash of its runs of five words."""
        n, k = len(self.hashes), WORDS
        total = np.zeros(max(n - k + 1, 0), np.uint64)
        for i in range(k):
            total = total * np.uint64(0xD6E8FEB86659FD93) + self.hashes[i : n - k + 1 + i]
        own = np.repeat(np.arange(len(self.last)), self.words)
        out = np.empty((len(seeds), len(self.last)), np.uint64)
        for row, seed in zip(out, seeds):
            value = np.full(n, np.iinfo(np.uint64).max)
            value[: len(total)] = np.where(own[: len(total)] == own[k - 1 :], mix(total ^ seed), value[: len(total)])
            row[:] = np.minimum.reduceat(value, self.first)
        return out

    def shingles(self, i: int) -> np.ndarray:
        """Sorted distinct hashes of the runs of five words of a paragraph."""
        return np.unique(shingle_hashes(self.hashes[self.first[i] : self.last[i] + 1], WORDS))


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, row, text): ``row`` tells texts with one id apart; null ids come last."""
    return columns(docs, doc_id="long", text="string").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("row"), "text"
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, row, place, node) of every paragraph of ``_keyed`` rows."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                own = Paragraphs(part.column("text"))
                text = pa.array(own.text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(text), part.column("row").take(text), pa.array(own.place.astype(np.int32)), pa.array(own.node)],
                    ["id", "row", "place", "node"],
                )

    return docs.mapInArrow(run, "id long, row long, place int, node long")


def band_rows(docs: DataFrame, bands: int, values: int) -> DataFrame:
    """(key, node): a row per band of every paragraph that can be like another but not equal."""
    seeds = mix(np.arange(1, bands * values + 1, dtype=np.uint64))
    fewest = -(-PERCENT // (100 - PERCENT)) + WORDS - 1  # with fewer words only equal ones are alike

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                own = Paragraphs(part.column("text"))
                if not len(own.node):
                    continue
                low = own.least(seeds).reshape(bands, values, -1)
                _, keep = np.unique(own.node, return_index=True)
                keep = keep[own.words[keep] >= fewest]
                keys = []
                for k in range(bands):
                    key = np.full(len(keep), k, np.uint64)
                    for v in range(values):
                        key = mix(key * np.uint64(31) + low[k, v, keep])
                    keys.append(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(own.node[keep], bands))], ["key", "node"]
                )

    return docs.select("text").mapInArrow(run, "key long, node long")


def _asked_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) of the paragraphs whose names are in ``asked``."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                own = Paragraphs(part.column("text"))
                wanted = [set(x) for x in part.column("asked").to_pylist()]
                hit = [i for i, (t, v) in enumerate(zip(own.text.tolist(), own.node.tolist())) if v in wanted[t]]
                nodes, sets = [int(own.node[i]) for i in hit], [own.shingles(i).tobytes() for i in hit]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.select("asked", "text").mapInArrow(run, "node long, shingles binary")


def shared_bands(rows: DataFrame) -> DataFrame:
    """(key, node, hub), each once, of the bands that several paragraph names share; the hub is the smallest."""
    of = Window.partitionBy("key")
    ends = {"hub": F.min("node").over(of), "high": F.max("node").over(of)}
    return rows.withColumns(ends).where("hub != high").select("key", "node", "hub").distinct()


def _apart(shared: DataFrame, joined: DataFrame) -> DataFrame:
    """(family, node, component, n) of the bands that still hold several components."""
    labelled = checkpointed(
        shared.join(shuffled(joined), "node", "left").select(F.col("key").alias("family"), "node", F.coalesce("component", "node").alias("component"))
    )
    open_ = labelled.groupBy("family").agg(
        F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    return labelled.join(shuffled(open_.where("low != high AND n > 2").select("family", "n")), "family")


def _links(keyed: DataFrame, where: DataFrame, bands: int, values: int) -> DataFrame:
    """Verified links (a, b) that connect all paragraph names that share a band and are alike.

    First each name against the hub of its band, then tiles of the bands still in several components.
    """
    shared = written(shared_bands(band_rows(keyed, bands, values)), "shared-bands")
    pairs = shared.where("hub != node").select("hub", F.col("node").alias("member")).distinct()
    needed = shared.select("node").distinct()
    # One occurrence of each is enough; a document is asked for all that it is the place of.
    place = where.join(shuffled(needed), "node").groupBy("node").agg(F.min(F.struct("id", "row")).alias("at"))
    asked = place.groupBy("at").agg(F.collect_list("node").alias("asked")).select("at.id", "at.row", "asked")
    sets = written(_asked_sets(keyed.join(shuffled(asked), ["id", "row"])).dropDuplicates(["node"]), "paragraph-sets")
    links = checkpointed(verified_stars(pairs, sets))
    return links.union(checkpointed(verified_tiles(_apart(shared, components(links)), sets)))


def repeated_paragraphs(keyed: DataFrame) -> DataFrame:
    """(id, row, places): per document, the paragraphs that occur before in their component.

    Copies within a document count too.  Rows equal in id and text are one document.
    """
    with Scratch() as scratch:
        where = written(occurrences(keyed), "paragraphs")
        with Scratch() as inner:
            joined = inner.keep(checkpointed(components(_links(keyed, where, *tuned_bands()))))
        counts = where.groupBy("node").agg(F.count("*").alias("n"))
        labels = checkpointed(
            counts.join(shuffled(joined), "node", "left")
            .where("n > 1 OR component IS NOT NULL")
            .select("node", F.coalesce("component", "node").alias("component"))
        )
        found = checkpointed(where.join(shuffled(labels), "node").select("id", "row", "place", "component"))
        first = found.groupBy("component").agg(F.min(F.struct("id", "row", "place")).alias("first"))
        later = found.join(shuffled(first), "component").where("struct(id, row, place) != first")
        # As many places as the document has paragraphs.
        places = later.groupBy("id", "row").agg(F.collect_set("place").alias("places"))
        return scratch.keep(checkpointed(places))


def runs_to_cut(own: Paragraphs, places: list, run_words: int) -> list[list[tuple[int, int]]]:
    """For each text the (start, end) of runs of listed paragraphs that have enough words."""
    listed = np.zeros(len(own.node), bool)
    for t, asked in enumerate(places):
        if asked:
            listed[np.searchsorted(own.text, t) + np.array(asked)] = True
    out: list[list[tuple[int, int]]] = [[] for _ in places]
    at = np.flatnonzero(listed)
    if len(at):
        new = np.append(True, (np.diff(at) > 1) | (np.diff(own.text[at]) > 0))
        starts = np.flatnonzero(new)
        words = np.add.reduceat(own.words[at], starts)
        stops = np.append(starts[1:], len(at)) - 1
        for a, b, n in zip(at[starts], at[stops], words):
            if n >= run_words:
                out[own.text[a]].append((int(own.start[a]), int(own.end[b])))
    return out


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    kept.append(text[at:])
    return "".join(kept)


def without_repeats(docs: DataFrame, run_words: int = RUN_WORDS, spans: str = "removed") -> DataFrame:
    """``docs`` with every repeated passage cut out of ``text``, and the spans (start, end) cut out.

    ``spans`` names their column, which ``docs`` must not have; all its other columns may
    have any names.

    Of each component the occurrence with the smallest doc_id, then place, stays.  Removed
    are runs of paragraphs that have at least ``run_words`` words, with the white space
    after them; spans are in code points of the text as it was.  The other columns pass
    unchanged.  A null or empty text stays as it is; rows with equal id and text are one
    document and keep or lose the same; a null doc_id comes after all others; an empty
    table gives no rows.
    """
    if spans.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {spans!r}; name another one for the spans")
    i, r, p = fresh(docs, "id", "row", "places")
    places = repeated_paragraphs(_keyed(docs)).select(F.col("id").alias(f"{i}2"), F.col("row").alias(f"{r}2"), F.col("places").alias(p))
    rows = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), r: F.xxhash64(F.col("text").cast("string"))})
    same = (F.col(i) == F.col(f"{i}2")) & (F.col(r) == F.col(f"{r}2"))
    joined = rows.join(shuffled(places), same, "left").select(*same_columns(docs), p)
    # By place, as the names may be such that no column can be asked for by them.
    joined = joined.toDF(*[f"c{k}" for k in range(len(joined.columns))])
    text_at, kept = docs.columns.index("text"), joined.columns[:-1]
    schema = T.StructType(
        [*joined.schema.fields[:-1], T.StructField("spans", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))]
    )

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in chunks(batch, f"c{text_at}"):
                asked, texts = part.column(len(kept)).to_pylist(), part.column(text_at)
                found_in: list = [[] for _ in asked]
                some = [at for at, x in enumerate(asked) if x]
                if some:
                    found = runs_to_cut(Paragraphs(texts.take(pa.array(some))), [asked[at] for at in some], run_words)
                    for at, own in zip(some, found):
                        found_in[at] = own
                    old = texts.to_pylist()
                    texts = pa.array([_cut(t, s) if s else t for t, s in zip(old, found_in)], texts.type)
                cols = [texts if k == text_at else part.column(k) for k in range(len(kept))]
                removed = pa.array([[{"start": a, "end": b} for a, b in s] for s in found_in], kind)
                yield pa.RecordBatch.from_arrays([*cols, removed], [*kept, "spans"])

    return joined.mapInArrow(run, schema).toDF(*docs.columns, spans)


@query("op7_passages")
def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select(
        "doc_id",
        F.expr("CAST(size(removed) AS bigint)").alias("n_removed"),
        F.expr("array_join(transform(removed, x -> concat(x.start, ':', x.end)), ',')").alias("removed"),
        "text",
    )
