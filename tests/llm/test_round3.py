"""Periodic runs, exact top-k and collocations against brute force and SQL."""

import hashlib
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest

from terracell.llm import phrases, pivots, runs

SF = "/root/testdata/sf0.001"


def _lyndon(w):
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def _runs(w):
    """By their statement: every period, its longest stretches, smallest period only."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays_and_runs_of_random_words():
    draw = random.Random(5)
    for _ in range(1500):
        n, k = draw.randint(0, 70), draw.choice([1, 2, 3, 5])
        w = [draw.randrange(k) for _ in range(n)]
        for _ in range(draw.randint(0, 3)):
            p = draw.randint(1, 8)
            a = draw.randint(0, n)
            for i in range(a + p, draw.randint(a, n)):
                w[i] = w[i - p]
        assert runs.lyndon_array(w) == _lyndon(w)
        assert runs.word_runs(np.array(w, np.int64)) == _runs(w)


def _said(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "", re.A)
    change = runs.repeated_tail(doc_id, len(words)) if words else None
    if change:
        a, p = change
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    found = _runs(words)
    dropped = {k for s, size, q in found for k in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
        sha(" ".join(w for k, w in enumerate(words) if k not in dropped)),
    )


def _keyed(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in map(lambda v: v if not isinstance(v, str) else int(v, 16), r)))


def test_runs_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    small = [d for d in docs if len(d.text or "") < 3000]
    found = {r.doc_id: tuple(r) for r in runs.op12_runs(spark, SF).collect()}
    assert len(found) == len(docs)
    assert sum(r[1] > 0 for r in found.values()) > 5
    for d in small:
        assert found[d.doc_id] == _said(d.doc_id, d.text)


def test_runs_of_odd_rows(spark):
    rows = [
        (1, "a b " * 9 + "c", 1), (1, "a b " * 9 + "c", 1), (2, "", 1), (3, None, 1), (None, "x " * 20, 1), (4, " \n\t ", 1),
        (5, "x y z " * 20_000, 1), (6, "x y " * 8 + " ", 1), (8, "p p p p p p q q q q q q p p p p p p " * 5, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = runs.periodic_runs(df).orderBy("doc_id").collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text, re.A)
        assert r.n_words == len(words)
        if len(words) < 1000:
            assert [tuple(x) for x in r.runs] == _runs(words)
    long = next(r for r in out if r.doc_id == 5)
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 3)] and long.collapsed == "x y z"
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_topk_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT query_id, rank, vec_id, score FROM ({pivots.SQL})").fetchall()
    got = [tuple(r) for r in pivots.op11_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("ring_rows", [8, 512])
def test_topk_of_odd_rows(spark, ring_rows):
    """Copies, ties, repeated ids, several lengths, very different norms, and vectors that take no part."""
    draw, rows = np.random.default_rng(0), []
    for i in range(600):
        if i % 7 == 0:
            v = [0.5, 0.25, -0.125]
        elif i % 11 == 0:
            v = draw.normal(size=2).tolist()
        else:
            v = (draw.normal(size=3) * 10 ** draw.integers(0, 4)).round(3).tolist()
        rows.append((i // 3 * 3 + i % 2, v, "x"))
    rows += [(300, [3e6, -2e6, 1e6], "x"), (350, [3e6, -2e6, 1e6], "x"), (700, [1.0] * 7, "z")]
    valid = list(rows)
    rows += [(None, [1.0, 2.0, 3.0], "x"), (50, None, "x"), (100, [], "x"), (150, [1.0, None, 2.0], "x")]
    rows += [(0, [float("nan"), 1.0, 1.0], "x"), (0, [float("inf"), 1.0, 1.0], "x"), (0, [1e300, 1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")
    got = sorted(map(tuple, pivots.top_k(df, "vec_id % 50 = 0", ring_rows=ring_rows).collect()))
    v = [(i, [int(np.floor(256 * x)) for x in e]) for i, e, _ in valid]
    want = []
    for a, (q, e) in enumerate(v):
        if q % 50 == 0:
            others = [(-sum(x * y for x, y in zip(e, f)), c) for b, (c, f) in enumerate(v) if b != a and len(f) == len(e)]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(others)[:5], 1)]
    assert got == sorted(want)
    assert pivots.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_later_rounds_skip_annuli(spark):
    """Clustered vectors: the bounds rule out most annuli after the first rounds."""
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(20, 8)) * 4
    rows = [(i, (centres[i % 20] + draw.normal(size=8) * 0.01).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = pivots.keyed(pivots.coded(df), found := pivots.picked(pivots.coded(df)))
    rings = pivots.annuli(index, 50).groupBy("pivot", "ring", "part").agg({"dist": "min", "norm2": "max"}).count()
    assert sum(map(len, found.values())) == pivots.PIVOTS and rings > 80
    got = {(r.query_id, r.vec_id) for r in pivots.top_k(df, "vec_id % 50 = 0", ring_rows=50).collect()}
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    for q in range(0, 4000, 50):
        s = x @ x[q]
        order = [c for c in np.lexsort((np.arange(4000), -s)) if c != q][:5]
        assert {(q, int(c)) for c in order} <= got


def _sql_phrases(docs):
    con = duckdb.connect()
    con.register("documents", docs)
    return sorted(con.execute(phrases.SQL).fetchall())


def test_phrases_match_sql(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, phrases.op13_phrases(spark, SF).collect()))
    assert got == _sql_phrases(docs) and len(got) > 20


def test_phrases_of_odd_rows(spark):
    rows = [("The cat sat on the mat\tquickly today, yes", None, 1)] * 31
    rows += [("the cat sat. on the the the the the the", None, 1)] * 40 + [(None, "en", 2), ("", "en", 1), ("x", "und", 1)]
    rows += [("A b c d e f g h i j k", "en", 0)] * 30 + [("a b;;c d\x0be f a b", "en", 0)] * 35
    rows += [("ÀB ÀB c?", "fr", 0)] * 50 + [("w " * 30_000, "xx", 1)]
    df = spark.createDataFrame(rows, "text string, lang string, gram int")
    docs = pd.DataFrame([r[:2] for r in rows], columns=["text", "lang"])
    got = sorted(map(tuple, phrases.phrases(df).collect()))
    assert got == _sql_phrases(docs) and {r[0] for r in got} == {"en", "fr", "und", "xx"}
    assert phrases.phrases(df.limit(0)).count() == 0


def test_unary_paths_are_compacted(spark):
    rows = [("a b c d e f g h i j k", "en")] * 30 + [("c d e f x", "en")] * 30
    docs = phrases._documents(spark.createDataFrame(rows, "text string, lang string"))
    grams = phrases.frequent_grams(phrases.longest_grams(docs, phrases.frequent_pairs(docs)))
    found = sorted((r.path, r.weight) for r in phrases.unary_paths(grams).collect())
    # A piece starts at c d e, and two ways leave d e f; the rest is one chain on either side.
    assert found == [("a b c d e", 30), ("c d e f", 60), ("d e f g h i j k", 30), ("d e f x", 30)]
    counts = {r.gram: r.n for r in grams.collect()}
    assert counts["c d e"] == counts["e f"] == 60 and counts["a"] == 30 and counts[""] == 480


def test_one_row_of_each_component_stays(spark):
    """Rows with one id and different texts, null ids, repeated rows, clashing and dotted names."""
    from terracell.llm import jaccard

    text = "a b c d e f g h"
    rows = [(1, text), (1, "unique words that stand alone here"), (0, text), (None, "p q r s t u v"), (None, "p q r s t u v"), (None, text)]
    rows += [(7, "m n o p q r"), (7, "m n o p q r"), (8, ""), (8, ""), (9, None), (None, None), (5, "x y"), (4, "X  Y"), (3, " \n")]
    data = [(*r, "k", i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id long, text string, `row.of` string, mark int")
    out = jaccard.one_of_each(df)
    assert out.columns == df.columns
    found = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    words = lambda t: tuple((t or "").lower().split())
    want, best = [], {}
    for i, t in rows:  # equal sets only, in these rows
        if not words(t):
            want.append((i, t))
        elif words(t) not in best or (i is None, i or 0) < (best[words(t)][0] is None, best[words(t)][0] or 0):
            best[words(t)] = (i, t)
    assert found == sorted([*want, *best.values()], key=str)
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_passages_keep_clashing_columns(spark):
    from terracell.llm import passages

    line = " ".join(f"word{k}" for k in range(40)) + "\n"
    df = spark.createDataFrame([(1, "One.\n" + line, 5, "x", 1), (2, line + "Two.", 6, "y", 2)], "doc_id long, text string, removed int, id string, `a.b` int")
    with pytest.raises(ValueError):
        passages.without_repeats(df)
    out = passages.without_repeats(df, spans="cut").orderBy("doc_id").collect()
    assert [(r.removed, r.id, r["a.b"]) for r in out] == [(5, "x", 1), (6, "y", 2)]
    assert out[0].text == df.first().text and out[1].text == "Two."


def test_tables_go_when_they_are_superseded(spark, tmp_path):
    import glob

    from terracell.llm import jaccard
    from terracell.llm.store import Scratch, written

    base = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{base}/*"))
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 3} h i j k") for i in range(30)], "doc_id long, text string")
    out = jaccard.labelled_rows(docs)
    left = set(glob.glob(f"{base}/*")) - before
    assert len(left) == 1 and out.count() == 30
    with Scratch() as outer:
        with Scratch() as inner:
            kept = inner.keep(written(docs, "kept"))
            written(docs, "gone")
        assert kept.count() == 30
    assert set(glob.glob(f"{base}/*")) - before == left
    assert not outer.tables.keys() - {kept._stored_at}


def test_one_id_on_several_vectors_is_one_node(spark):
    from terracell.llm import vectors

    rows = [(3, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [0.0, 1.0], 1), (9, [-1.0, 0.0], 1)]
    out = vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.component_id, r.kept) for r in out) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True)]


def test_special_strings_are_encoded_as_the_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    from terracell.llm import packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for text in ("hello <|endoftext|> there", "<|endoftext|>", "a<|endoftext|><|endoftext|> b\n", "<|endoftext|", "no such string"):
        ids = np.frombuffer(packing.encoder(path).encode(text), "<u2").tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids


def test_keys_of_few_sets_tie_no_family(spark):
    """A chain of unlike sets, three to a key, is one family of all; listed pairs keep it in pairs."""
    from terracell.llm import jaccard

    n = 60
    rows = [(k, k + j, 10, (10, k)) for k in range(n) for j in range(3)]
    shared = spark.createDataFrame(rows, "key long, node long, size long, hub struct<size long, node long>")
    joined = spark.createDataFrame([], "node long, component long")
    found = jaccard.open_rows(shared, joined)
    pairs = {(r.hub, r.member) for r in jaccard.open_pairs(found).collect()}
    assert pairs == {(k + 1, k + 2) for k in range(n)}  # the star of k has compared k with both
    assert jaccard._unsettled(found, joined).count() == 0
    settled = spark.createDataFrame([(k, 0) for k in range(n + 2)], "node long, component long")
    assert jaccard.open_rows(shared, settled).count() == 0


def test_parities_lose_no_similar_pair(spark):
    from terracell.llm import jaccard

    rng, sets = np.random.default_rng(3), []
    for k in range(40):
        own = rng.integers(0, 1 << 63, 30 + 20 * k, dtype=np.uint64)
        gone = (100 - jaccard.PERCENT) * len(own) // 100  # as many as a similar set may lack
        sets += [np.unique(own), np.unique(own[gone:]), np.unique(np.append(own[len(own) // 2 :], rng.integers(0, 1 << 63, len(own) // 2, dtype=np.uint64)))]
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, shingles binary")
    pairs = [(i, i + j) for i in range(0, len(sets), 3) for j in (1, 2)]
    marks = jaccard.parities(table)
    kept = {tuple(r) for r in jaccard.sifted(spark.createDataFrame(pairs, "hub long, member long"), marks).collect()}
    alike = {(a, b) for a, b in pairs if jaccard.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))}
    assert kept == alike and len(alike) == 40


def test_joins_of_components_pass_nothing_through_the_driver(spark, plan_of, monkeypatch):
    """Small tables as these are broadcast by Spark's size check; larger ones in compressed files were, too."""
    from terracell.llm import graph, jaccard, store

    plans = []

    def seen(df, name="checkpoint"):
        plans.append(plan_of(df))
        return store.written(df, name)

    for module in (jaccard, graph):
        monkeypatch.setattr(module, "checkpointed", seen)
    monkeypatch.setattr(jaccard, "written", seen)
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 3} h i j k w{i // 20}") for i in range(60)], "doc_id long, text string")
    out, kept = jaccard.join_documents(docs), jaccard.one_of_each(docs)
    plans += [plan_of(out), plan_of(kept)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert out.count() == 60 and kept.count() == out.select("component_id").distinct().count()


def test_joins_of_passages_pass_nothing_through_the_driver(spark, plan_of, monkeypatch):
    from terracell.llm import graph, jaccard, passages, store

    plans = []

    def seen(df, name="checkpoint"):
        plans.append(plan_of(df))
        return store.written(df, name)

    for module in (jaccard, graph, passages):
        monkeypatch.setattr(module, "checkpointed", seen)
    monkeypatch.setattr(passages, "written", seen)
    line = " ".join(f"word{k}" for k in range(40)) + "\n"
    docs = spark.createDataFrame([(i, f"Start {i}.\n{line}End {i}.") for i in range(3)], "doc_id long, text string")
    out = passages.without_repeats(docs)
    plans.append(plan_of(out))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert [r.text for r in out.orderBy("doc_id").collect()] == [f"Start 0.\n{line}End 0.", "Start 1.\nEnd 1.", "Start 2.\nEnd 2."]
