"""URL filter over a sorted array of digests.

Every rule (host and path prefix) is a 64-bit xxhash key in one sorted array, with the
rule's full text beside it.  The file is written once to the shared folder, shipped with
``addFile`` and memory-mapped by the workers.  A url's candidate rules (its host and
parent domains, times the path lengths that rules have) are hashed, found by a
vectorised binary search and confirmed against the stored text, so a digest collision
never decides.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from terracell.llm.registry import query, read
from terracell.llm.store import columns, shared_path

#: (verdict, host and path), as given with the query's contract.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MAX_INDEX_BYTES = 1 << 30
_HEAD = 4  # counts at the head of the file


def build_index(rules: Iterable[tuple[str, str]]) -> bytes:
    """The file: counts, sorted keys, text offsets, verdicts, path lengths, texts.

    A rule given twice keeps its last verdict.  The path begins at the first ``/``.
    """
    verdicts = {rule: verdict for verdict, rule in rules}
    rows = sorted((xxhash.xxh64_intdigest(rule.encode()), rule.encode(), v == "block") for rule, v in verdicts.items())
    keys = np.array([r[0] for r in rows], dtype="<u8")
    texts = b"".join(r[1] for r in rows)
    offsets = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8")
    blocks = np.array([r[2] for r in rows], dtype="<u8")
    lengths = np.array(sorted({len(r.split("/", 1)[1]) + 1 if "/" in r else 0 for r in verdicts}), dtype="<u8")
    head = np.array([len(keys), len(lengths), len(texts), 0], dtype="<u8")
    out = b"".join(x.tobytes() for x in (head, keys, offsets, blocks, lengths)) + texts
    if len(out) > MAX_INDEX_BYTES:
        raise ValueError(f"the rules take {len(out)} bytes, more than {MAX_INDEX_BYTES} in a file for each executor")
    return out


class Index:
    """The memory-mapped file."""

    def __init__(self, path: str):
        words = np.memmap(path, dtype=np.uint8, mode="r")
        n, n_lengths, n_text, _ = (int(x) for x in words[: 8 * _HEAD].view("<u8"))
        at = 8 * _HEAD

        def take(count):
            nonlocal at
            part = words[at : at + 8 * count].view("<u8")
            at += 8 * count
            return part

        self.keys, self.offsets, self.blocks = take(n), take(n + 1), take(n)
        self.lengths = [int(x) for x in take(n_lengths)]
        self.texts = words[at : at + n_text]

    def text(self, i: int) -> bytes:
        return self.texts[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def find(self, names: list[bytes]) -> np.ndarray:
        """The entry of each name, -1 where it has none."""
        out = np.full(len(names), -1)
        if not len(self.keys) or not names:
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), dtype=np.uint64, count=len(names))
        left = np.searchsorted(self.keys, digests, side="left")
        right = np.searchsorted(self.keys, digests, side="right")
        for i in np.flatnonzero(right > left):
            out[i] = next((k for k in range(left[i], right[i]) if self.text(k) == names[i]), -1)
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty for null and without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, rest[end:stop]


def _candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    names = [host]
    at = host.find(".")
    while at >= 0:
        names.append(host[at + 1 :])
        at = host.find(".", at + 1)
    tail = path.encode()
    return [n.encode() + tail[:k] for n in names if n for k in lengths if k <= len(tail)]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages(page_id, url)``.

    A rule ``host/path`` fits its host and all subdomains when the url's path starts with
    the rule's; the longest that fits decides (of equal length the first in the alphabet),
    else ``default``.  A null url or one without ``://`` has empty host and path and fits
    no rule.  Repeated rows are judged each; a null page_id stays null; other columns are
    ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    blob = build_index(rules)
    name = f"urls-{xxhash.xxh64_hexdigest(blob)}.idx"
    _ship(spark, blob, name)
    return columns(pages, page_id="long", url="string").mapInArrow(
        lambda batches: _judge(batches, name, default),
        "page_id long, host string, path string, rule string, verdict string",
    )


def _ship(spark: SparkSession, blob: bytes, name: str) -> None:
    """Writes the file through Spark's file system and has every executor fetch it, once a session."""
    if any(name in path for path in spark.sparkContext.listFiles):
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_path(spark, 'index')}/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path, True)
    out.write(bytearray(blob))
    out.close()
    spark.sparkContext.addFile(files.makeQualified(path).toString())


_open: dict[str, Index] = {}


def _judge(batches, name: str, default: str):
    if name not in _open:
        _open[name] = Index(SparkFiles.get(name))
    index = _open[name]
    for batch in batches:
        split = [split_url(u) for u in batch.column("url").to_pylist()]
        names, owner = [], []
        for i, (host, path) in enumerate(split):
            found = _candidates(host, path, index.lengths)
            names += found
            owner += [i] * len(found)
        entry = index.find(names)
        best: dict[int, tuple[int, bytes, int]] = {}
        for k in np.flatnonzero(entry >= 0):
            i, rule = owner[k], names[k]
            if i not in best or (-len(rule), rule) < (-len(best[i][1]), best[i][1]):
                best[i] = (i, rule, int(entry[k]))
        rules = [best[i][1].decode() if i in best else None for i in range(len(split))]
        verdicts = [("block" if index.blocks[best[i][2]] else "allow") if i in best else default for i in range(len(split))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                pa.array([h for h, _ in split], pa.string()),
                pa.array([p for _, p in split], pa.string()),
                pa.array(rules, pa.string()),
                pa.array(verdicts, pa.string()),
            ],
            ["page_id", "host", "path", "rule", "verdict"],
        )


SQL = r"""
WITH r(verdict, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'),
                                 ('allow', 'com/fr/'), ('block', 'com/de/')),
rules AS (SELECT verdict, rule, split_part(rule, '/', 1) rhost, substr(rule, instr(rule, '/')) rpath FROM r),
a AS (SELECT row_number() OVER () n, page_id,
             CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM pages),
b AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path FROM a),
c AS (SELECT b.*, rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, rule) k
      FROM b LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') verdict FROM c WHERE k = 1
"""


@query("op8_url_filter", SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), RULES)
