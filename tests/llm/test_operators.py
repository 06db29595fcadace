"""Every training-data operator against brute force, a round trip or held-out labels."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from terracell.llm import fingerprints, jaccard, packing, passages, pieces, private, quality, secrets, urls, vectors
from terracell.llm.graph import components

SF = "/root/testdata/sf0.001"
LONG = "Lorem ipsum dolor. " * 3000
ODD = [
    (1, "a@b.co token = abcdefgh1 +49 30 1234567 the quick brown fox jumps.", "en", 5),
    (1, "a@b.co token = abcdefgh1 +49 30 1234567 the quick brown fox jumps.", "en", 5),
    (2, "", None, None),
    (3, None, "de", 0),
    (None, "x", "fr", 1),
    (4, "   \n\t ", None, 3),
    (5, LONG, "la", len(LONG)),
    (6, "naïve ▁ text  with  spaces\n\n\U0001f600 <|endoftext|>", "xx", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, a repeated row, and columns named like internal ones."""
    rows = [(*r, "n", 1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, node string, size int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_secret_patterns_match_brute_force(spark, texts):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    for row in secrets.op1_secrets(spark, SF).collect():
        t = texts[row.doc_id]
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert hashlib.sha256(said.encode()).hexdigest() == row.base_sha256
        assert set(filter(None, said.split(","))) <= set(row.spans.split(","))


def test_random_strings_are_told_from_words(spark):
    rng = np.random.default_rng(5)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    made = ["".join(rng.choice(list(a), 30 if a[0] == "0" else 44)) for a in alphabets for _ in range(20)]
    plain = ["enbescherverauheitverachber", "get_user_name_from_request_context", "z" * 40, "2020-05-17-2020-05-18-2020"]
    rows = [(i, f"x {w} y") for i, w in enumerate(made + plain)]
    found = secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    hit = {r.doc_id: r.r for r in found.select("row.doc_id", secrets.redacted().alias("r")).collect()}
    assert sum(hit[i] == "x [secret] y" for i in range(40)) >= 36
    assert all(hit[40 + i] == f"x {w} y" for i, w in enumerate(plain))


def test_random_strings_after_an_equals_sign(spark):
    rng = np.random.default_rng(9)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    forms = ["AWS_SECRET_ACCESS_KEY={}", "https://a.b/c?sig={}&x=1", "auth={}", "k={}=="]
    rows = [(i, forms[i % 4].format("".join(rng.choice(letters, 44)))) for i in range(40)]
    plain = ["x=enbescherverauheitverachber", "x=get_user_name_from_request_context", "x=" + "z" * 40]
    table = spark.createDataFrame(rows + [(40 + i, w) for i, w in enumerate(plain)], "doc_id long, text string")
    hit = {r.doc_id: r.r for r in secrets.secret_spans(table).select("row.doc_id", secrets.redacted().alias("r")).collect()}
    clean = [f.format("[secret]").replace("]==", "]") for f in forms]
    assert sum(hit[i] == clean[i % 4] for i in range(40)) >= 36
    assert all(hit[40 + i] == w for i, w in enumerate(plain))


def test_secrets_edge_cases(odd):
    rows = secrets.secret_spans(odd).select("row.doc_id", secrets.said("base").alias("s")).collect()
    assert len(rows) == len(ODD) and sorted(r.s for r in rows if r.s) == ["assign:7:24"] * 2
    assert secrets.secret_spans(odd.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.op2_quality(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = found[found.held_out]
    assert (out.held_out == (out.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3) == 1)).all()
    assert (out.predicted == out.quality).mean() > 0.95
    assert ((found.score >= 0.5) == (found.predicted == 1)).all()


def test_quality_edge_cases(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    none = quality.classify(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(odd.limit(0), labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_fingerprints(spark, docs, texts):
    rows = {r.doc_id: r for r in fingerprints.op3_fingerprints(spark, SF).collect()}
    ids = sorted(texts, reverse=True)
    assert sorted(rows, reverse=True) == ids
    for own, after in zip(ids, ids[1:] + ids[:1]):
        k = len(texts[own]) // 3
        edited = texts[own][: len(texts[own]) - k] + texts[after][:k]
        assert rows[own].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[own].n_chars == len(texts[own])
        assert 0 <= rows[own].near_next <= 1 and 0 <= rows[own].near_edited <= 1
    by_text = collections.defaultdict(set)
    for d, t in texts.items():
        by_text[t].add(rows[d].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    mean = lambda c: np.mean([getattr(r, c) for r in rows.values()])
    assert mean("near_edited") > 0.3 > 0.1 > mean("near_next")


def test_fingerprint_lexicon_matches_counts(docs, texts):
    counts = collections.Counter()
    import pyarrow as pa

    for own in fingerprints.term_sets(pa.array(texts.values())):
        counts.update(own.tolist())
    n = len(texts)
    want = sorted(t for t, c in counts.items() if c >= n / 50 and c <= n / 10)
    assert fingerprints.lexicon(docs, low=1 / 50).tolist() == want


def test_fingerprints_edge_cases(odd):
    terms = fingerprints.lexicon(odd)
    assert fingerprints.edit_likeness(odd, terms).count() == len(ODD)
    assert fingerprints.edit_likeness(odd.limit(0), terms).count() == 0
    assert fingerprints.fingerprints(odd, terms).count() == len(ODD)
    assert len(fingerprints.lexicon(odd.limit(0))) == 0


def test_private_patterns_match_brute_force():
    rng = np.random.default_rng(3)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(5000):
        t = "".join(rng.choice(list("a.b@@.-+ 0123456789()é\n"), rng.integers(0, 30)))
        want = [(0, m.start(), m.end()) for m in email.finditer(t)]
        want += [(1, m.start(), m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [s for s in private.base_spans(t) if s[0] < 2] == want
    assert private.base_spans("4111 1111 1111 1111 +1 (743) 555-3824") == [(2, 0, 19), (3, 20, 37)]
    assert private.base_spans("4111 1111 1111 1112") == []


def test_field_finds_what_patterns_miss_and_leaves_the_rest():
    own = private.field()
    runs = private.labelled_runs()
    decoded = own.decode([private._indices(w) for w, _ in runs])
    assert np.mean([a == b for (_, y), d in zip(runs, decoded) for a, b in zip(y, d)]) > 0.98
    found = private.find_private(["call (743) 555-3824 now", "on 2020-05-17 at 10:30 it was 1,299.00", "order 2021-000123-4477"], own)
    assert [e for _, e in found] == [[(3, 5, 19)], [], []]


def test_viterbi_matches_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    n = len(private.LABELS)
    own = private.Field(rng.normal(size=(private.BUCKETS, n)), rng.normal(size=(n, n)), rng.normal(size=n))
    run = rng.integers(0, private.BUCKETS, (4, private.FEATURES))
    scores = own.unary[run].sum(axis=1)
    best = max(
        itertools.product(range(n), repeat=4),
        key=lambda y: own.first[y[0]] + sum(scores[k, y[k]] for k in range(4)) + sum(own.steps[y[k], y[k + 1]] for k in range(3)),
    )
    assert own.decode([run.tolist()]) == [list(best)]


def test_private_edge_cases(odd):
    rows = private.private_spans(odd).collect()
    assert len(rows) == len(ODD) and [r.n_email for r in rows].count(1) == 2
    assert private.private_spans(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + 0.12 * rng.normal(size=16)).tolist(), i % 3 % 2) for i in range(120)]
    rows += [(200, rows[0][1], rows[0][2]), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0)]
    rows += [(205, [None] * 16, 0), (206, [1.0], 0), (207, [2.0], 0), (None, rows[1][1], rows[1][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    found = {r.vec_id: r for r in vectors.link_vectors(table, block=block).collect()}
    held = {r.vec_id: r for r in table.collect()}
    links = collections.defaultdict(set)
    for a in held.values():
        for b in held.values():
            if None in (a.vec_id, b.vec_id) or a.vec_id == b.vec_id or a.label is None or a.label != b.label or not a.embedding or not b.embedding:
                continue
            if None in a.embedding or None in b.embedding or len(a.embedding) != len(b.embedding):
                continue
            x, y = np.array(a.embedding), np.array(b.embedding)
            if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a.vec_id].add(b.vec_id)
    assert len(found) == len(rows)
    for own, row in found.items():
        if own is None:
            assert (row.n_links, row.component_id, row.kept) == (0, None, False)
            continue
        seen, todo = {own}, [own]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert (row.n_links, row.component_id, row.kept) == (len(links[own]), min(seen), own == min(seen))


def test_vectors_empty_table(spark):
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def _sets(texts):
    out = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        out[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    return out


def _components(links, nodes):
    low = {n: n for n in nodes}
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            return low


def test_jaccard_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = {}
    for i in range(150):  # short and middling texts with edits of all strengths
        if i % 3 or not texts:
            words = [f"w{k}" for k in rng.integers(0, 3000, rng.integers(1, 60))]
        else:
            words = texts[int(rng.integers(0, i))].split()
            for _ in range(rng.integers(0, 3)):
                words[rng.integers(0, len(words))] = f"e{rng.integers(0, 9)}"
            words += ["Tail"] * int(rng.integers(0, 3))
        texts[i] = " ".join(words)
    found = jaccard.join_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    sets = _sets(texts)
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    low = _components(links, sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {d: (len(sets[d]), low[d]) for d in sets}


def test_similar_sets_always_share_a_key():
    rng = np.random.default_rng(9)
    for _ in range(400):
        size = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = a[rng.random(len(a)) < 0.95]
        b = np.unique(np.append(b, rng.integers(0, 1 << 63, rng.integers(0, size // 8 + 1)).astype(np.uint64)))
        if len(b) and jaccard.similar(len(np.intersect1d(a, b)), len(a), len(b)):
            keys = [np.concatenate([k for _, _, k in jaccard.index_keys(x)]) for x in (a, b)]
            assert len(np.intersect1d(*keys))


def test_tiles_link_what_stars_leave(spark):
    chain = [np.arange(k, 100 + k, dtype=np.uint64) for k in range(0, 60, 10)]  # neighbours alike, ends not
    sets = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(chain)], "node long, shingles binary")
    groups = spark.createDataFrame([(0, k, k, len(chain)) for k in range(len(chain))], "family long, node long, component long, n long")
    found = components(jaccard.verified_tiles(groups, sets)).collect()
    assert {r.component for r in found} == {0} and len(found) == len(chain)


def test_jaccard_edge_cases(odd):
    rows = jaccard.join_documents(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id in (1, 2, 3, 4)} == {(d, d) for d in (1, 2, 3, 4)}
    assert [r.n_shingles for r in rows if r.doc_id in (2, 3, 4)] == [0, 0, 0]
    assert jaccard.join_documents(odd.limit(0)).count() == 0


def _passage_docs():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.integers(5, 12))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(9))
    own = [" ".join(sentence() for _ in range(12)) for _ in range(30)]
    texts = {i: t for i, t in enumerate(own)}
    for i in (3, 11, 19):
        w = own[i].split(" ")
        texts[i] = " ".join(w[:20]) + " " + passage + " " + " ".join(w[20:])
    return texts, passage


def test_passages_go_where_they_repeat(spark):
    texts, passage = _passage_docs()
    table = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in passages.without_repeats(table).collect()}
    assert {d for d, r in rows.items() if r.removed} == {11, 19}
    assert all(rows[d].text == t for d, t in texts.items() if d not in (11, 19))
    for d in (11, 19):
        gone = sum(len(texts[d][a:b].split()) for a, b in rows[d].removed)
        assert gone >= 0.6 * len(passage.split())
        assert all(texts[d][a:b] in passage for a, b in rows[d].removed)
        assert rows[d].lang == "x"


def test_near_copies_under_an_unlike_hub(spark):
    """Families of edited paragraphs that all share a five-word phrase, against brute force over equal bands."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    bands, values = passages.tuned_bands()
    seed = passages.mix(np.arange(1, 2, dtype=np.uint64))
    some = [" ".join(word() for _ in range(5)) for _ in range(2000)]
    # The phrase whose five-word run is the smallest: the first band puts all that hold it under one key.
    phrase = some[int(np.argmin(passages.Paragraphs(pa.array(some)).least(seed)[0]))]
    texts = []
    for _ in range(12):
        own = [word() for _ in range(11)]
        texts += [" ".join([word(), *own[1:], phrase]) for _ in range(4)]
    keyed = passages._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    shared, sets = collections.defaultdict(set), {}
    for r in passages.band_rows(keyed, bands, values).collect():
        shared[r.key].add(r.node)
    for t in texts:
        own = passages.Paragraphs(pa.array([t]))
        sets |= {int(own.node[i]): own.shingles(i) for i in range(len(own.node))}
    links = [
        (a, b) for g in shared.values() for a in g for b in g
        if a < b and jaccard.similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
    ]
    want = {n: c for n, c in _components(links, sets).items() if any(n in x for x in links)}
    found = components(passages._links(keyed, passages.occurrences(keyed), bands, values)).collect()
    assert {r.node: r.component for r in found} == want and max(map(len, shared.values())) > 12


def test_eight_words_are_like_nine_that_hold_them(spark):
    eight = "one two three four five six seven eight"
    keyed = passages._keyed(spark.createDataFrame([(0, eight), (1, eight + " nine")], "doc_id long, text string")).cache()
    links = passages._links(keyed, passages.occurrences(keyed), *passages.tuned_bands()).collect()
    nodes = {r.node for r in passages.occurrences(keyed).collect()}
    assert {n for r in links for n in r} == nodes and len(nodes) == 2


def test_passages_edge_cases(odd):
    rows = passages.without_repeats(odd).collect()
    assert len(rows) == len(ODD)
    same = {(r.doc_id, r.text) for r in rows if r.doc_id in (2, 3, 4)}
    assert same == {(2, ""), (3, None), (4, "   \n\t ")}
    assert passages.without_repeats(odd.limit(0)).count() == 0


def test_url_filter_sql(spark):
    import duckdb

    rows = [(1, "http://A.Example.org/en/12?x"), (2, "https://example.org/es/"), (3, "http://x.com/fr/1#a"), (4, None), (5, "nothing")]
    rows += [(6, "ftp://com/de/x"), (7, "http://org"), (8, "http://org:80/"), (None, "http://notorg/"), (9, "http://x.com?u=http://y.org/")]
    pages = pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"})
    con = duckdb.connect()
    con.register("pages", pages)
    want = sorted(map(str, con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.SQL})").fetchall()))
    table = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    found = urls.filter_urls(table, urls.RULES)
    assert sorted(str(tuple(r)) for r in found.collect()) == want
    assert urls.filter_urls(table.limit(0), urls.RULES).count() == 0


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b))
    path = tmp_path / "index"
    path.write_bytes(urls.build_index([("block", "a.org/"), ("allow", "b.org/")]))
    index = urls.Index(str(path))
    assert [int(i) >= 0 for i in index.find([b"a.org/", b"b.org/", b"c.org/", b"x"])] == [True, True, False, False]


def test_pieces_match_the_library(texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, lib = pieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(8)
    letters = [chr(c) for c in range(300)] + list("▁▁  \n\t日本\U0001f600é́​")
    cases = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(3000)] + list(texts.values()) + ["a" * 500, " ", ""]
    for t in cases:
        ids = lib.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids)
        assert own.round_trip(t) == (len(ids), ",".join(map(str, ids)).encode(), lib.decode(ids).encode())
    for t in cases[:300]:
        proto = lib.encode(t, return_type="proto")
        assert own.spans(t) == [(p.id, p.begin, p.end) for p in proto.pieces]


def test_query_gives_source_ends_of_pieces(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own = pieces.model(path)
    rng = np.random.default_rng(10)
    letters = [chr(c) for c in range(300)] + list("▁▁  \n\t日本\U0001f600é́​")
    cases = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(1000)] + [" ", "  a", "a▁ b", ""]
    for t in cases:
        spans = own.spans(t)
        assert own.aligned([t])[0][3].tolist() == [b for _, _, b in spans]
        assert [a for _, a, _ in spans] == [0, *(b for _, _, b in spans[:-1])][: len(spans)]
    for row in pieces.op9_pieces(spark, SF).limit(50).collect():
        ends = np.array([b for _, _, b in own.spans(texts[row.doc_id])], "<i8")
        assert row.ends_sha256 == hashlib.sha256(ends.tobytes()).hexdigest()


def test_char_map_takes_the_longest_prefix():
    # A double array by hand: "a" becomes "x", "ab" becomes "yz".
    units = [0] * 512
    base = lambda b: b << 10
    units[0] = base(256)
    units[256 ^ ord("a")] = ord("a") | base(64) | 1 << 8
    node = 256 ^ ord("a") ^ 64
    units[node] = 1 << 31 | 0
    units[node ^ ord("b")] = ord("b") | base(128) | 1 << 8
    units[node ^ ord("b") ^ 128] = 1 << 31 | 2
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"x\0yz\0"
    chars = pieces.CharMap(blob)
    assert chars.longest(b"abc", 0) == (2, b"yz")
    assert chars.longest(b"ac", 0) == (1, b"x")
    assert chars.longest(b"c", 0) is None


def test_pieces_edge_cases(odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert pieces.round_trip(odd, path).count() == len(ODD)
    assert pieces.encode_documents(odd.limit(0), path).count() == 0
    assert pieces.piece_spans(odd, path).count() == len(ODD)


def _check_packing(rows, texts, length=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = np.array(tok.encode(texts[d], add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at & (at - 1) == 0 and at <= length  # no padding at all


def test_packing(spark, texts):
    _check_packing(packing.op10_packing(spark, SF).collect(), texts)


def test_hilbert_curve_steps_to_neighbours():
    for bits, dims in ((3, 2), (2, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing_edge_cases(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_pieces(odd, path).collect()
    assert sum(r.length for r in rows if r.doc_id in (2, 3)) == 2
    assert packing.pack_pieces(odd.limit(0), path).count() == 0


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (1, 2), (2, 2), (None, 3), (9, 6), (9, 6), (20, 30), (30, 40), (40, 50), (50, 20)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {9: 6, 8: 6, 7: 6, 6: 6, 1: 1, 2: 1, 20: 20, 30: 20, 40: 20, 50: 20}
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def test_pipeline_stages(spark, docs, texts):
    """Each stage against its operator's own result, and the last against the packed texts."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "passages", "secrets", "packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, held = held, spark.createDataFrame(stage(spark, held, SF).collect(), docs.schema)
        assert held.columns == docs.columns
        ids = {r.doc_id for r in held.collect()}
        if name == "quality":
            assert ids == good
        elif name == "near_duplicates":
            own = {r.doc_id: r.text or "" for r in before.collect()}
            sets = _sets(own)
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert ids == set(_components(links, sets).values())
        else:
            assert ids == {r.doc_id for r in before.collect()}
            assert all(r.n_chars == len(r.text) for r in held.collect() if r.text is not None)
        if name == "secrets":
            left = "\n".join(r.text or "" for r in held.collect())
            assert not re.search(r"[0-9a-f]{32}", left) and not re.search("AKIA[A-Z0-9]{12}", left)
    _check_packing(corpus_pipeline.run(spark, SF).collect(), {r.doc_id: r.text or "" for r in held.collect()})
