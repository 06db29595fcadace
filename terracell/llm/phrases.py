"""Collocations of two to four words from a weighted graph of overlapping grams.

Edges are grams of four words between nodes of three.  Each place of a piece gives one
edge, or the shorter gram that the end of its piece leaves, so one aggregation counts
them all; the count of a shorter gram is the flow out of its node: the edges that begin
with it, and the pieces that end in it.  A node that passes on all of its flow is inside
a unary path; paths are compacted by pointer doubling and carry one weight for all their
edges and inner nodes.

A first pass finds pairs of words that are frequent enough to stand in a phrase, up to
chance collisions in a bitmap of fixed size.  A pair outside it ends a piece like a stop
does: all occurrences of a frequent gram lie between such ends, so its count is whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from terracell.llm.registry import query, read
from terracell.llm.store import columns, written
from terracell.llm.words import chunks, mix, text_bytes, word_hashes

WORDS = 4  # of the longest phrase
LEAST = 30  # occurrences of a phrase
TOP = 2000  # phrases of a language
SHARE = 80  # percent of its occurrences that a phrase may have inside a longer one, less one
PARTS = 64  # of a language's phrases, for ranking
UNIT = 2_000_000
BITS = 1 << 27  # of the bitmap of frequent pairs: 16 MB, whatever the corpus
HELD = 1 << 22  # pairs that a task holds before it counts them
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BREAK = _STOP.copy()
_BREAK[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pairs(texts: pa.Array, lang: str):
    """Bytes, begin and end of all words, and for each the hash of the pair with the next (0 at a piece's end)."""
    data, begins = text_bytes(texts)
    hashes, begin, end, before = word_hashes(data, begins, _BREAK)
    pair = np.zeros(len(hashes), np.uint64)
    if len(hashes) > 1:
        stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int32)])
        joined = stops[end[:-1]] == stops[begin[1:]]
        last = before[1:-1]
        joined[last[(last > 0) & (last < len(hashes))] - 1] = False  # another document follows
        salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        both = mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] + salt) | np.uint64(1)
        pair[:-1] = np.where(joined, both, 0)
    return data, begin, end, pair


def _by_language(batches):
    """(language, texts) of about a megabyte each."""
    for batch in batches:
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            for part in chunks(batch.filter(pc.equal(langs, lang))):
                yield lang, part.column("text")


def _documents(docs: DataFrame) -> DataFrame:
    return columns(docs, text="string", lang="string").withColumn("lang", F.coalesce("lang", F.lit("und")))


def frequent_pairs(docs: DataFrame, least: int = LEAST) -> np.ndarray:
    """Bitmap of the hashes of all pairs of words with ``least`` occurrences in a language, and of some others."""

    def run(batches):
        held, size = [], 0

        def counted():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], ["pair", "n"])

        for lang, texts in _by_language(batches):
            pair = _pairs(texts, lang)[3]
            held.append(pair[pair != 0])
            size += len(held[-1])
            if size >= HELD:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    counts = docs.mapInArrow(run, "pair long, n int").groupBy("pair").agg(F.sum("n").alias("n"))
    bit = F.shiftrightunsigned("pair", 37) + 1  # the first 27 of 64 bits; positions count from 1
    rows = (
        counts.where(F.col("n") >= least)
        .select(bit.alias("bit"))
        .groupBy(F.bitmap_bucket_number("bit").alias("at"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()  # at most BITS / 32,768 rows of 4 KB
    )
    bits = np.zeros(BITS // 8, np.uint8)
    for row in rows:
        own = np.frombuffer(row.bits, np.uint8)
        bits[(row.at - 1) * 4096 : (row.at - 1) * 4096 + len(own)] = own
    return bits


def _edges(texts: pa.Array, lang: str, bits: np.ndarray):
    """Distinct longest grams of some texts and how often each stands there; the first row counts all words."""
    data, begin, end, pair = _pairs(texts, lang)
    n = len(begin)
    yield pa.array([""]), np.array([n])
    if not n:
        return
    place = pair >> np.uint64(37)
    joined = (pair != 0) & ((bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1)
    # The words again, lower-cased and each with one space behind it: grams are slices of that.
    size = end - begin + 1
    to = np.concatenate([[0], np.cumsum(size)])
    flat = np.arange(to[-1]) + np.repeat(begin - to[:-1], size)
    flat[to[1:] - 1] = 0
    flat = _LOWER[data[flat]]
    flat[to[1:] - 1] = 32
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(to), pa.py_buffer(flat)])
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    more = np.zeros((WORDS - 1, n), bool)  # whether the gram from a place has 2, 3, 4 words
    more[0] = joined
    for k in range(1, WORDS - 1):
        more[k, :-1] = joined[:-1] & more[k - 1, 1:]
    two = np.zeros(n, np.int64)  # exact number of each pair
    at = np.flatnonzero(joined)
    two[at] = np.unique(ids[at] * n + ids[at + 1], return_inverse=True)[1]
    length = 1 + more.sum(axis=0)
    for k in range(1, WORDS + 1):
        at = np.flatnonzero(length == k)
        if not len(at):
            continue
        key = ids[at] if k == 1 else two[at]
        if k == 3:
            key = key * n + ids[at + 2]
        elif k == 4:
            key = key * n + two[at + 2]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        a, b = to[first], to[first + k] - 1
        cuts = np.concatenate([[0], np.cumsum(b - a)])
        out = flat[np.arange(cuts[-1]) + np.repeat(a - cuts[:-1], b - a)]
        grams = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(cuts), pa.py_buffer(out))
        yield grams.cast(pa.string()), counts


def longest_grams(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(lang, gram, n): edges of four words, and shorter grams where a piece or its frequent pairs end.

    The gram '' counts all words of a language.
    """
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for lang, texts in _by_language(batches):
            for grams, counts in _edges(texts, lang, held.value):
                names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(grams), np.int8)), pa.array([lang])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, grams, pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    grams = docs.mapInArrow(run, "lang string, gram string, n long")
    return grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _words(gram: str = "gram") -> F.Column:
    return F.when(F.col(gram) == "", 0).otherwise(F.length(gram) - F.length(F.replace(gram, F.lit(" "))) + 1)


def frequent_grams(edges: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, gram, k, n): all grams with ``least`` occurrences, shorter ones by the flow of their nodes.

    The row of '' (all words of a language) stays whatever its count.
    """
    edges = edges.withColumn("k", _words())
    flows = [edges.where(f"k = {WORDS}").select("lang", "gram", "n")]
    for k in range(WORDS - 1, 0, -1):
        ends = edges.where(F.col("k") == k).select("lang", "gram", "n")
        node = F.substring_index("gram", " ", k).alias("gram")
        flows.append(flows[-1].select("lang", node, "n").union(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    out = edges.where("k = 0").select("lang", "gram", "n")
    for flow in flows:
        out = out.union(flow.where(F.col("n") >= least))
    return out.withColumn("k", _words())


def unary_paths(grams: DataFrame) -> DataFrame:
    """(lang, path, weight): chains of edges whose inner nodes have no other way in or out.

    ``path`` has all words of the chain, joined by a space.  A node is inner when an edge
    into it and one out of it both carry its whole count, so no piece starts or ends in
    it and no other word follows.
    """
    nodes = grams.where(f"k = {WORDS - 1}").select("lang", F.col("gram").alias("node"), F.col("n").alias("flow"))
    edges = grams.where(f"k = {WORDS}").select(
        "lang",
        "gram",
        "n",
        F.substring_index("gram", " ", WORDS - 1).alias("tail"),
        F.substring_index("gram", " ", 1 - WORDS).alias("head"),
    )
    full = lambda end, name: edges.withColumnRenamed(end, "node").join(nodes, ["lang", "node"]).where("n = flow").select("lang", "node", F.col("gram").alias(name))
    links = written(full("head", "before").join(full("tail", "gram"), ["lang", "node"]).select("lang", "before", "gram"), "links")
    # Pointer doubling: each linked edge learns the first edge of its path and how far it is.
    firsts = links.select("lang", F.col("before").alias("gram")).join(links, ["lang", "gram"], "left_anti")
    at = links.withColumn("far", F.lit(1)).union(firsts.select("lang", F.col("gram").alias("before"), "gram", F.lit(0)))
    at = written(at, "paths")
    reach, farthest = 0, at.agg(F.max("far")).first()[0]
    while farthest is not None and farthest > reach:
        reach = farthest
        up = at.select("lang", F.col("gram").alias("before"), F.col("before").alias("first"), F.col("far").alias("further"))
        at = at.join(up, ["lang", "before"]).select("lang", F.col("first").alias("before"), "gram", (F.col("far") + F.col("further")).alias("far"))
        at = written(at, "paths")
        farthest = at.agg(F.max("far")).first()[0]
    chains = at.groupBy("lang", F.col("before").alias("gram")).agg(
        F.sort_array(F.collect_list(F.struct("far", F.substring_index("gram", " ", -1).alias("word")))).alias("rest")  # of one piece
    )
    rest = F.array_join(F.expr("transform(filter(rest, x -> x.far > 0), x -> x.word)"), " ")
    inside = at.where("far > 0").select("lang", "gram")
    joined = edges.join(inside, ["lang", "gram"], "left_anti").join(chains, ["lang", "gram"], "left")
    return joined.select("lang", F.concat_ws(" ", "gram", F.nullif(rest, F.lit(""))).alias("path"), F.col("n").alias("weight"))


def _windows(words: str, k: int) -> str:
    """SQL: an array of (place, gram) of the k-word grams of an array of words; empty where it has fewer."""
    return (
        f"transform(filter(sequence(1, greatest(size({words}) - {k - 1}, 1)), i -> i + {k - 1} <= size({words})),"
        f" i -> named_struct('place', i, 'gram', array_join(slice({words}, i, {k}), ' ')))"
    )


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language.

    Texts of ``docs(text, lang)``, A-Z lower-cased, are split at ``[.,;:!?\\x0A-\\x0D]``
    into pieces and those into words ``[^\\x20\\x09]+``.  n counts the words of a language.
    A phrase has 2 to ``WORDS`` words and occurs a >= ``least`` times, overlaps included.
    Cut after its first word or a later one, its parts occur l and r times; the cut with
    the lowest floor(2000000 a / (l + r)) counts, of equal ones the first.  A phrase is
    dropped when ``share`` percent of a are within the count of a longer one that holds
    its words.  Order: score descending, a descending, phrase by its bytes.

    A null text is empty, a null lang counts as ``und``.  Repeated rows count each.
    Other columns are ignored; an empty table, or one without frequent phrases, gives no
    rows.  Texts are read whole, however long.  All counts are exact; only the lists of
    phrases are cut, at ``top``.
    """
    docs = _documents(docs)
    bits = frequent_pairs(docs, least)
    edges = written(longest_grams(docs, bits), "edges")
    grams = written(frequent_grams(edges, least), "grams")
    paths = written(unary_paths(grams), "unary").select("lang", F.split("path", " ").alias("w"), "weight")
    # Edges with what their path says of their nodes; inner nodes are dropped, as an edge has their whole count.
    long = paths.select("lang", F.col("weight").alias("a"), F.size("w").alias("size"), F.explode(F.expr(_windows("w", WORDS))).alias("x"))
    long = long.select(
        "lang",
        F.col("x.gram").alias("phrase"),
        F.lit(WORDS).alias("k"),
        "a",
        F.when(F.col("x.place") > 1, F.col("a")).alias("left_flow"),
        F.when(F.col("x.place") < F.col("size") - WORDS + 1, F.col("a")).alias("right_flow"),
    )
    inner = paths.where(F.size("w") > WORDS).select("lang", F.explode(F.expr(_windows("slice(w, 2, size(w) - 2)", WORDS - 1))).alias("x"))
    short = grams.where(f"k BETWEEN 2 AND {WORDS - 1}").join(
        inner.select("lang", F.col("x.gram").alias("gram")), ["lang", "gram"], "left_anti"
    )
    none = F.lit(None).cast("long")
    short = short.select("lang", F.col("gram").alias("phrase"), "k", F.col("n").alias("a"), none.alias("left_flow"), none.alias("right_flow"))
    found = written(long.union(short), "candidates")

    words = found.withColumn("w", F.split("phrase", " "))
    within = [
        words.where(f"k > {k}").select("lang", "a", F.explode(F.expr(_windows("w", k))).alias("x")) for k in range(2, WORDS)
    ]
    covers = within[0]
    for other in within[1:]:
        covers = covers.union(other)
    covers = covers.groupBy("lang", F.col("x.gram").alias("phrase")).agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits
    kept = found.join(covers, ["lang", "phrase"], "left").where(
        F.coalesce(wide("longer") * 100 < wide("a") * share, F.lit(True))
    )

    cut = F.explode(F.expr("sequence(1, k - 1)")).alias("cut")
    cuts = kept.select("lang", "phrase", "k", "a", "left_flow", "right_flow", cut)
    sides = F.explode(
        F.expr(
            "array(named_struct('left', true, 'part', substring_index(phrase, ' ', cut), 'flow', IF(cut = k - 1, left_flow, NULL)),"
            " named_struct('left', false, 'part', substring_index(phrase, ' ', cut - k), 'flow', IF(cut = 1, right_flow, NULL)))"
        )
    ).alias("side")
    parts = cuts.select("lang", "phrase", "a", "cut", sides).select("lang", "phrase", "a", "cut", "side.*")
    looked = parts.where("flow IS NULL").drop("flow").join(
        grams.where(f"k BETWEEN 1 AND {WORDS - 1}").select("lang", F.col("gram").alias("part"), F.col("n").alias("flow")), ["lang", "part"]
    )
    counts = parts.where("flow IS NOT NULL").unionByName(looked.select(*parts.columns))
    one = lambda cut, left: F.max(F.when((F.col("cut") == cut) & (F.col("left") == left), F.col("flow")))
    by_cut = counts.groupBy("lang", "phrase", "a").agg(
        *[one(c, s).alias(f"{'l' if s else 'r'}{c}") for c in range(1, WORDS) for s in (True, False)]
    )
    scored = [
        f"IF(l{c} IS NULL, NULL, named_struct('score', CAST(a AS DECIMAL(20,0)) * {UNIT} div (CAST(l{c} AS DECIMAL(20,0)) + r{c}), 'cut', {c}, 'l', l{c}, 'r', r{c}))"
        for c in range(1, WORDS)
    ]
    best = by_cut.withColumn("best", F.expr(f"array_min(array_compact(array({', '.join(scored)})))"))
    totals = grams.where("k = 0").select("lang", F.col("n").alias("n"))
    ranked = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    # The best of each of some parts of a language hold the best of it all: no task has more than their lists.
    ranked = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) s FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(s, '[\\x20\\x09]+'), lambda x: x != '') w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') g, count(*) a
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) i FROM w, (SELECT unnest([1, 2, 3, 4]) k))
      GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, g, a, string_split(g, ' ') w FROM g WHERE k > 1),
t AS (SELECT c.lang, c.g, c.a, j, x.a l, y.a r, CAST(CAST(c.a AS HUGEINT) * {UNIT} // (x.a + y.a) AS BIGINT) score
      FROM (SELECT *, unnest(range(1, k)) j FROM c) c
      JOIN g x ON x.lang = c.lang AND x.g = array_to_string(c.w[1:j], ' ')
      JOIN g y ON y.lang = c.lang AND y.g = array_to_string(c.w[j + 1:c.k], ' ')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) z FROM t) WHERE z = 1),
o AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') g, max(a) longer
      FROM (SELECT *, unnest(range(1, k - m + 2)) i FROM (SELECT *, unnest(range(2, k)) m FROM c)) GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.g)) AS rank
      FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g
      WHERE o.longer IS NULL OR CAST(100 AS HUGEINT) * o.longer < CAST({SHARE} AS HUGEINT) * b.a)
SELECT q.lang, q.rank, q.g AS phrase, q.a, q.l, q.r, n.n, q.score FROM q JOIN n ON n.lang = q.lang WHERE rank <= {TOP}
"""


@query("op13_phrases", SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(read(spark, sf_dir, "documents"))
