"""Runs of words that repeat with a short period, and texts without the repeats.

Baier's grouping: groups of suffixes are taken from the largest down, and each tells the
nearest smaller suffix before its members how far its own Lyndon word reaches.  The
length a group has when its turn comes is the longest Lyndon word at each of its places,
so the first phase of the suffix sorter gives the Lyndon array at once.  Under both
orders of the alphabet every run shows one of its Lyndon roots there; a root is extended
to a run by the mismatches of its period to its left and right.

Grouping is sequential, so places that no run can hold are cut away first: every three
consecutive words of a run with exponent four stand in it at least three times.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.llm.registry import query, read
from terracell.llm.store import columns
from terracell.llm.words import chunks

MIN_LENGTH = 6  # words of a run, and
MIN_EXPONENT = 4  # periods of a run: 4 at least, or the cut below would lose runs
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place."""
    n = len(ranks)
    members: dict[int, list[int]] = {}
    for i, r in enumerate(ranks, 1):  # place 0 is a sentinel that is never taken
        members.setdefault(r, []).append(i)
    start = sorted(members)
    group = [-1, *ranks]
    length = dict.fromkeys(start, 1)
    above = dict(zip(start, [*start[1:], None]))
    below = dict(zip(start, [None, *start[:-1]]))
    fresh = max(start, default=0) + 1
    left = list(range(n + 1))  # the nearest place to the left, itself included, still to be taken
    found = [0] * n
    now = start[-1] if start else None
    while now is not None:
        size = length[now]
        own = [i for i in members.pop(now) if group[i] == now]
        for i in own:
            found[i - 1] = size
            left[i] = i - 1
        times: dict[int, int] = {}
        for i in own:
            j = i
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            left[i] = j
            if j:
                times[j] = times.get(j, 0) + 1
        split: dict[int, dict[int, list[int]]] = {}
        for j, k in times.items():
            split.setdefault(group[j], {}).setdefault(k, []).append(j)
        for old, by_times in split.items():
            lower, upper = old, above[old]
            for k in sorted(by_times):
                members[fresh] = moved = by_times[k]
                length[fresh] = length[old] + k * size
                for j in moved:
                    group[j] = fresh
                above[lower], below[fresh] = fresh, lower
                lower = fresh
                fresh += 1
            above[lower] = upper
            if upper is not None:
                below[upper] = lower
        now = below[now]
    return found


def dense_parts(ids: np.ndarray) -> list[tuple[int, int]]:
    """Stretches in which all three-word grams stand at least three times, until that holds.

    A run lies in one stretch, together with any word that would extend it.
    """
    parts, todo = [], [(0, len(ids))]
    while todo:
        a, b = todo.pop()
        if b - a < MIN_LENGTH:
            continue
        w = ids[a:b].astype(np.uint64)
        grams = (w[:-2] * _A + w[1:-1]) * _B + w[2:]  # equal hashes only keep more
        ordered = np.sort(grams)
        often = np.unique(ordered[2:][ordered[2:] == ordered[:-2]])
        if not len(often):
            continue
        keep = often[np.minimum(np.searchsorted(often, grams), len(often) - 1)] == grams
        if keep.all():
            parts.append((a, b))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
        todo += [(a + int(s), a + int(e) + 2) for s, e in zip(edges[::2], edges[1::2])]
    return parts


def part_runs(w: np.ndarray) -> set[tuple[int, int, int]]:
    """(first place, end, period) of the runs of one stretch."""
    n = len(w)
    ranks = np.unique(w, return_inverse=True)[1]
    off: dict[int, np.ndarray] = {}  # by period, the places that differ from the one a period on
    runs = set()
    for order in (ranks, ranks.max() - ranks):
        roots = np.array(lyndon_array(order.tolist()))
        at = np.arange(n)
        fits = MIN_EXPONENT * roots <= n
        fits &= at + 2 * roots <= n
        at, roots = at[fits], roots[fits]
        same = (w[at] == w[at + roots]) & (w[at + roots - 1] == w[at + 2 * roots - 1])
        until: dict[int, int] = {}
        for i, q in zip(at[same].tolist(), roots[same].tolist()):
            if i < until.get(q, 0) or not np.array_equal(w[i : i + q], w[i + q : i + 2 * q]):
                continue
            if q not in off:
                off[q] = np.flatnonzero(w[:-q] != w[q:])
            k = int(np.searchsorted(off[q], i))
            first = int(off[q][k - 1]) + 1 if k else 0
            until[q] = end = (int(off[q][k]) if k < len(off[q]) else n - q) + q
            if end - first >= max(MIN_LENGTH, MIN_EXPONENT * q):
                runs.add((first, end, q))
    return runs


def word_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    found = [(a + s, e - s, q) for a, b in dense_parts(ids) for s, e, q in part_runs(ids[a:b])]
    return sorted(found, key=lambda run: (run[0], run[2]))


def periodic_runs(docs: DataFrame, tail: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs(doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch of words with
    smallest period q, of ``MIN_LENGTH`` words and ``MIN_EXPONENT`` periods at least, that
    can't be longer on either side.  ``runs`` has (start, length, period) by start, then
    period; ``collapsed`` joins the words by one space, without those that stand in a run
    after its first q words.  With ``tail``, a document is read as if each word from
    place a on repeated the p words from there, where (a, p) = tail(doc_id, n_words);
    None leaves it as it is.

    A null text is empty: no words, no runs, an empty ``collapsed``.  A null doc_id stays
    null.  Repeated rows each give a row.  Other columns are ignored; an empty table
    gives no rows.  A text is worked on whole, however long.
    """

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                yield _chunk(part, tail)

    return columns(docs, doc_id="long", text="string").mapInArrow(
        run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"
    )


def _chunk(batch: pa.RecordBatch, tail) -> pa.RecordBatch:
    names = batch.column("doc_id").to_pylist()
    texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
    sizes, runs, counts, collapsed = [], [], [], []
    for name, text in zip(names, texts):
        words = text.split()  # of bytes: at 20 and 09 to 0D
        n = len(words)
        ids = np.fromiter(map({}.setdefault, words, range(n)), np.int64, n)
        repeat = tail(name, n) if tail is not None and n else None
        if repeat is not None:
            a, p = repeat
            order = np.arange(n)
            order[a:] = a + (order[a:] - a) % p
            ids, words = ids[order], [words[i] for i in order.tolist()]
        found = word_runs(ids)
        if found:
            keep = np.ones(n, bool)
            for s, size, q in found:
                keep[s + q : s + size] = False
            words = compress(words, keep.tolist())
        sizes.append(n)
        runs += found
        counts.append(len(found))
        collapsed.append(b" ".join(words))
    fields = np.array(runs, np.int64).reshape(-1, 3)
    items = pa.StructArray.from_arrays([pa.array(fields[:, k]) for k in range(3)], ["start", "length", "period"])
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), items), pa.array(collapsed, pa.binary()).cast(pa.string())],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The change that op12's contract makes to a tenth of the documents, by crc32 of the id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


@query("op12_runs")
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(read(spark, sf_dir, "documents"), repeated_tail)
    best = F.expr(
        "get(array_sort(runs, (x, y) -> CASE"
        " WHEN x.length * y.period > y.length * x.period THEN -1 WHEN x.length * y.period < y.length * x.period THEN 1"
        " WHEN x.start != y.start THEN IF(x.start < y.start, -1, 1)"
        " WHEN x.period != y.period THEN IF(x.period < y.period, -1, 1) ELSE 0 END), 0)"
    )
    lines = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
