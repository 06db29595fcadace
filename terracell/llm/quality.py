"""Regularised quadratic discriminant over transformed document statistics.

Each text becomes a short vector of statistics.  Per class, mean and covariance come
from sums over the labelled rows; the covariance is shrunk towards the pooled one and
towards its diagonal, and its Cholesky factor is computed once.  A text's score is the
logistic of the difference of the two Mahalanobis log-densities and the class priors.
"""

from __future__ import annotations

import dataclasses
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.llm.registry import query, read
from terracell.llm.store import columns, written
from terracell.llm.words import chunks

NAMES = (
    "log_words log_word_length log_line_words symbols_per_word digits upper capitals_inside marked_words"
    " ends_sentence repeated_lines repeated_words top_word bars accents_free long_words log_chars"
).split()
_ENDINGS = (".", "!", "?", '"', "”", "…")
_UPPER = re.compile(r"[^\W\d_a-z]{2,}")


def _odds(share: float, n: int) -> float:
    """Log odds of a share seen in ``n`` cases, pulled a little to the middle."""
    return float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; those of an empty text are defined too."""
    words = text.split()
    n, chars = len(words), len(text)
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    counts = Counter(words)
    alnum = letters = upper = digits = marked = inside = long_words = 0
    seen = 0
    for word, times in counts.items():
        seen += len(word) * times
        if word.isalpha():
            a = len(word)
            letters += a * times
            alnum += a * times
        else:
            a = sum(map(str.isalnum, word))
            alnum += a * times
            letters += sum(map(str.isalpha, word)) * times
            digits += sum(map(str.isdigit, word)) * times
            marked += times * (len(word) - a >= 2)
        if not word.islower():
            up = sum(map(str.isupper, word))
            upper += up * times
            inside += times * (up >= 2)
        long_words += times * (len(word) > 20)
    bars = sum(text.count(c) for c in "|<>{}[]#*$%&=~^\\_")
    return [
        np.log1p(n),
        np.log1p(seen / max(n, 1)),
        np.log1p(n / max(len(lines), 1)),
        np.log1p((seen - alnum) / max(n, 1)),
        _odds(digits / max(seen, 1), seen),
        _odds(upper / max(letters, 1), letters),
        _odds(inside / max(n, 1), n),
        _odds(marked / max(n, 1), n),
        _odds(sum(x.endswith(_ENDINGS) for x in lines) / max(len(lines), 1), len(lines)),
        _odds(1 - len(set(lines)) / max(len(lines), 1), len(lines)),
        _odds(1 - len(counts) / max(n, 1), n),
        _odds(max(counts.values(), default=0) / max(n, 1), n),
        _odds(bars / max(seen, 1), seen),
        _odds(letters / max(seen, 1), seen),
        _odds(long_words / max(n, 1), n),
        np.log1p(chars),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of each row of ``docs(doc_id, text)``; a null text is empty."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                rows = [statistics(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"]
                )

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, x array<double>")


@dataclasses.dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log constants of both classes, and the features' scale."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    prior: float  # log odds of label 1
    half_words: float  # a text of so many words counts half of its evidence

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; the fewer words, the nearer to the prior."""
        if not len(x):
            return np.zeros(0)
        z = np.clip((x - self.center) / self.scale, -8, 8)
        logs = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants)]
        n = np.expm1(x[:, NAMES.index("log_words")])
        odds = self.prior + n / (n + self.half_words) * (logs[1] - logs[0])
        return 1 / (1 + np.exp(np.clip(-odds, -500, 500)))


def fit(labelled: DataFrame, pooled: float = 0.2, diagonal: float = 0.1, half_words: float = 8.0) -> Discriminant:
    """Fits on ``labelled(x, y)`` with y 0 or 1, from sums over all its rows.

    ``pooled`` and ``diagonal`` are the shares of the pooled covariance and of the scaled
    identity in each class covariance.  With no row of a class, that class gets the other
    one's shape and the prior of half a row; with no row at all every score is one half.
    """
    d = len(NAMES)

    def sums(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, d)
            y = np.array(batch.column("y").to_pylist(), dtype=int)
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                s[c] += own.sum(axis=0)
                q[c] += own.T @ own
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1]), pa.array([[n[c], *s[c], *q[c].ravel()] for c in (0, 1)], pa.list_(pa.float64()))],
            ["y", "sums"],
        )

    per_part = labelled.mapInArrow(sums, "y long, sums array<double>")
    # Two rows, each of fixed length: the sum over all parts.
    total = per_part.select("y", F.posexplode("sums").alias("k", "v")).groupBy("y", "k").agg(F.sum("v").alias("v"))
    flat = np.zeros((2, 1 + d + d * d))
    for row in total.collect():  # 2 x (1 + d + d * d) numbers, whatever the size of the input
        flat[row.y, row.k] = row.v
    n, s, q = flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d)
    count = max(n.sum(), 1.0)
    center = s.sum(axis=0) / count
    spread = np.sqrt(np.maximum(np.diag(q.sum(axis=0)) / count - center**2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    means, covariances = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        if n[c]:
            m = s[c] / n[c]
            means[c] = (m - center) / scale
            covariances[c] = (q[c] / n[c] - np.outer(m, m)) / np.outer(scale, scale)
    both = (n[:, None, None] * covariances).sum(axis=0) / count
    factors, constants = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        weight = min(1.0, pooled + (1 - pooled) * d / (d + n[c]))  # few rows lean on the pooled shape
        shrunk = (1 - weight) * covariances[c] + weight * both
        shrunk = (1 - diagonal) * shrunk + diagonal * max(np.trace(shrunk) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        factors[c] = np.linalg.inv(lower)
        constants[c] = -np.log(np.diag(lower)).sum()
    prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    return Discriminant(means, factors, constants, center, scale, prior, half_words)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score, predicted) of ``document_statistics`` rows."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(-1, len(NAMES))
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y) of the documents that have a quality label of 0 or 1 and aren't held out.

    A document labelled twice counts once, with its lower label; so does one that stands
    in the documents twice with equal statistics.  Null ids and labels are left out.
    """
    known = (
        columns(labels, doc_id="long", quality="int")
        .where("quality IN (0, 1) AND doc_id IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("long").alias("y"))
    )
    return stats.where("doc_id IS NOT NULL").join(known, "doc_id").select("x", "y")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, quality)`` where crc32 of the id modulo 3 isn't 1, from
    all such rows.  A null text is scored as an empty one; repeated rows are scored each
    alike; a null doc_id isn't held out; other columns are ignored; an empty table gives
    no rows, and without labels every score is one half.
    """
    stats = written(document_statistics(docs), "statistics")
    model = fit(labelled_rows(stats, labels))
    return scored(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good; fitted as in ``classify``.

    Texts are scored where they stand, so none is shuffled.  Nulls and repeated rows are
    treated as there; all columns pass unchanged.
    """
    model = fit(labelled_rows(written(document_statistics(docs), "statistics"), labels))

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                x = np.array([statistics(t or "") for t in part.column("text").to_pylist()])
                yield part.filter(pa.array(model.scores(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
