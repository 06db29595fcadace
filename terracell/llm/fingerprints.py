"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band.  A text keeps
its distinct lexicon terms, sorted, and the hash of those that lie in a random subset of
the lexicon is one part of its fingerprint.  Subsets come in families that halve from
level to level; a text uses the levels at which a subset keeps about one of its terms, so
texts of any length can agree in some parts and differ in others.

The band is given as shares of the documents.  A document of d distinct terms adds d to
the sum of all frequencies, so at most mean(d) / low terms reach the lower share: the
lexicon's size doesn't grow with the corpus, and it is broadcast behind a check of that.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.llm.registry import query, read
from terracell.llm.store import columns, parts
from terracell.llm.words import chunks, mix, text_bytes, word_hashes

#: Share of the documents that a lexicon term is in: from one in 2,000 to one in 10.
LOW, HIGH = 1 / 2000, 1 / 10
FAMILIES, LEVELS = 32, 3
#: Texts with fewer lexicon terms also get a part over all their terms.
FEW = 12
#: A worker holds a hash and ``FAMILIES`` bytes for each term: 320 MB at most.
MAX_LEXICON = 320_000_000 // (8 + FAMILIES)
SLICE = 65_536

# Terms are runs of letters and digits; other ASCII characters part them.
_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[:128] = [not chr(c).isalnum() for c in range(128)]
_SEEDS = mix(np.arange(1, FAMILIES + 1, dtype=np.uint64))


def term_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct term hashes of each text."""
    data, begins = text_bytes(texts)
    words, _, _, before = word_hashes(data, begins, _BREAKS)
    return [np.unique(words[a:b]) for a, b in zip(before[:-1], before[1:])]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all rows of ``docs(text)``; counts are added up in the workers first."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flushed():
            terms, place = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            df = np.bincount(place, np.concatenate([n for _, n in held]), len(terms)).astype(np.int64)
            for a in range(0, len(terms), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms[a : a + 100_000].view(np.int64)), pa.array(df[a : a + 100_000])], ["term", "df"]
                )

        for batch in batches:
            for part in chunks(batch):
                terms, df = np.unique(np.concatenate(term_sets(part.column("text"))), return_counts=True)
                held.append((terms, df))
                size += len(terms)
                if size > 4_000_000:
                    yield from flushed()
                    held, size = [], 0
        if size:
            yield from flushed()

    counted = columns(docs, text="string").where("text IS NOT NULL").mapInArrow(run, "term long, df long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    n = docs.count()
    inside = document_frequencies(docs).where((F.col("df") >= low * n) & (F.col("df") <= max(high * n, 1))).select("term")
    terms = inside.limit(MAX_LEXICON + 1).toPandas()["term"].to_numpy(dtype=np.int64)
    if len(terms) > MAX_LEXICON:
        raise ValueError("the band holds too many terms for a broadcast: raise its lower share")
    return np.sort(terms.view(np.uint64))


class Marker:
    """Makes fingerprints; holds for each lexicon term how deep it reaches in each family."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.depth = self._depth(terms)

    @staticmethod
    def _depth(terms: np.ndarray) -> np.ndarray:
        """A byte for each term and family, drawn in slices: the draws themselves take 16 times as much."""
        out = np.empty((len(terms), FAMILIES), np.uint8)
        for at in range(0, len(terms), SLICE):
            draws = mix(terms[at : at + SLICE, None] ^ _SEEDS[None, :])
            out[at : at + SLICE] = (63 - np.floor(np.log2(np.maximum(draws, 1).astype(np.float64)))).clip(0, 63)
        return out

    def fingerprint(self, own: np.ndarray) -> str:
        """Of a sorted distinct term set: parts ``kind level:hashes``; empty for no terms.

        Kind b is over the lexicon, kind a over all terms.  A hash of zeros stands for a
        subset with no term of the text.
        """
        if not len(own):
            return ""
        at = np.searchsorted(self.terms, own)
        at[at == len(self.terms)] = 0
        inside = self.terms[at] == own if len(self.terms) else np.zeros(len(own), bool)
        said = []
        if inside.any():
            said += self._parts("b", own[inside], self.depth[at[inside]])
        if inside.sum() < FEW:
            said += self._parts("a", own, self._depth(own))
        return ";".join(said)

    @staticmethod
    def _parts(kind: str, terms: np.ndarray, depth: np.ndarray) -> list[str]:
        level = int(np.log2(len(terms)) + 0.5)
        value = mix(terms + np.uint64(1))
        out = []
        for k in range(level, level + LEVELS):
            total = mix((value[:, None] * (depth >= k)).sum(axis=0, dtype=np.uint64)) >> np.uint64(32)
            total[~(depth >= k).any(axis=0)] = 0
            out.append(f"{kind}{k}:" + total.astype(">u4").tobytes().hex())
        return out


def likeness(a: str, b: str) -> float:
    """Share of the subsets, of those that hold a term of either text, in which both hash alike.

    Only levels that both fingerprints have count, of the kind that agrees most; without
    any it is 0, and of two empty fingerprints it is 1.
    """
    if a == b:
        return 1.0
    found = {"a": [0, 0], "b": [0, 0]}
    other = dict(p.split(":") for p in b.split(";") if p)
    for part in a.split(";"):
        name, _, own = part.partition(":")
        if name in other:
            x, y = (np.frombuffer(bytes.fromhex(h), ">u4") for h in (own, other[name]))
            found[name[0]][0] += int(((x == y) & (x != 0)).sum())
            found[name[0]][1] += int(((x != 0) | (y != 0)).sum())
    return max((same / all_ for same, all_ in found.values() if all_), default=0.0)


def fingerprints(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint) for each row of ``docs(doc_id, text)``; a null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        own = _marker(shared)
        for batch in batches:
            for part in chunks(batch):
                said = [own.fingerprint(t) for t in term_sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(said)], ["doc_id", "fingerprint"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fingerprint string")


_made: dict = {}


def _marker(shared) -> Marker:
    if shared.value is not _made.get("terms"):
        _made.update(terms=shared.value, marker=Marker(shared.value))
    return _made["marker"]


def _bucket(bounds: list[int]) -> F.Column:
    """How many bounds lie below the key, by halving steps."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    listed = "array(" + ",".join(f"{b}L" for b in bounds) + ")"
    return F.expr(f"""aggregate(array({",".join(map(str, steps))}), 0, (lo, s) ->
        CASE WHEN lo + s <= {len(bounds)} AND get({listed}, lo + s - 1) < key THEN lo + s ELSE lo END)""")


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guard, key, doc_id, text), dealt by ranges of doc_id and sorted downwards.

    After the rows of a bucket (guard 0) comes the first row of the next bucket (guard 1),
    so that a task sees the follower of each of its rows; after the last bucket comes the
    very first row.  Bounds and guards are a number per bucket.  Null ids come last.
    """
    keyed = columns(docs, doc_id="long", text="string").withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63) + 1)))
    n = parts(docs)
    at = ", ".join(f"{k / n}" for k in range(1, n))
    bounds = keyed.agg(F.expr(f"percentile_approx(key, array({at}), 20000)")).first()[0] if n > 1 else []
    dealt = keyed.withColumn("bucket", _bucket(sorted(set(bounds or []))))
    tops = {r.bucket: r.top for r in dealt.groupBy("bucket").agg(F.max("key").alias("top")).collect()}
    order = sorted(tops)
    after = [(tops[low], high) for low, high in zip(order, order[1:])] + [(tops[order[-1]], order[0])] if order else []
    guards = dealt.sparkSession.createDataFrame(after, "key long, bucket int")
    first = (
        dealt.drop("bucket")
        .join(F.broadcast(guards), "key")  # a row per bucket
        .select("bucket", F.lit(1).alias("guard"), "key", "doc_id", "text")
    )
    both = dealt.select("bucket", F.lit(0).alias("guard"), "key", "doc_id", "text").union(first)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "guard", F.desc("key"), "text")


def _paired(batches):
    """(doc_id, text, next text), from the rows of ``neighbours``."""
    bucket = last = None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("bucket", "guard", "doc_id", "text")))
        for own, guard, doc_id, text in rows:
            text = text or ""
            if own != bucket:
                bucket, last = own, None
            if last is not None:
                yield (*last, text)
            last = None if guard else (doc_id, text)


def edit_likeness(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Fingerprints of each row of ``docs(doc_id, text)``, of its edited text, and their likeness.

    The edited text has its last third (rounded down, in code points) replaced by the
    first as many code points, or all, of the next document, which has the next smaller
    doc_id; after the smallest comes the largest.  A null text is empty; rows with the
    same id follow one another by text; null ids come after all others; a single document
    follows itself; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        own = _marker(shared)
        held: list[tuple] = []
        size = 0

        def flushed():
            edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for _, t, f in held]
            marks = [
                [own.fingerprint(s) for s in term_sets(pa.array(texts, pa.large_string()))]
                for texts in ([t for _, t, _ in held], edited, [f for _, _, f in held])
            ]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _, _ in held], pa.int64()),
                    pa.array([len(t) for _, t, _ in held], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array(marks[0]),
                    pa.array(marks[1]),
                    pa.array([likeness(a, b) for a, b in zip(marks[0], marks[1])]),
                    pa.array([likeness(a, b) for a, b in zip(marks[0], marks[2])]),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for row in _paired(batches):
            held.append(row)
            size += len(row[1]) + len(row[2])
            if size > 8 << 20:
                yield flushed()
                held, size = [], 0
        if held:
            yield flushed()

    return neighbours(docs).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return edit_likeness(docs, lexicon(docs))
