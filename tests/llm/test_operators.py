"""Each operator on small hand-made tables, with nulls, empty and very long texts, ties, repeated rows, empty tables and
extra columns with clashing names, against brute force."""

import base64
import hashlib
import random
import shutil
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.llm import ann, bpe, langid, linededup, mixing, simhash, substring, tokenfile, topk, warc

RNG = random.Random(5)
VOCAB = ["alpha", "beta", "gamma", "delta", "eps", "zeta,", "eta", "théta", "İota", "x\x1cy", "ß", "don't"]


def text(n, sep=" "):
    return sep.join(RNG.choice(VOCAB) for _ in range(n))


LONG = text(60_000)
SHARED = text(30)
DOCS = [
    (1, text(40) + " " + SHARED, "en", "s1"), (2, SHARED + " " + text(10), "en", "s1"), (3, None, None, None), (4, "", "de", "s2"), (5, " \n\t ", "de", "s2"),
    (6, LONG, "en", "s0"), (7, LONG, "en", "s0"), (8, text(3), "fr", "s3"), (9, "word", "fr", "s3"), (10, text(50, "\n"), "en", "s1"), (11, "12 34", "en", None),
    (None, SHARED, "en", "s1"), (12, SHARED + "\n" + SHARED, "en", "s4"), (13, "a b " * 40, "de", "s2"), (13, "a b " * 40, "de", "s2"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names the operators use themselves."""
    rows = [(*r, 7, "z", 1.5) for r in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp long, _id string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def words_of(t):
    return (t or "").encode().split()


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# 1. WARC


def test_warc(spark):
    pages = [(3, "u3", "<p>a</p>"), (1, "u\r\n1", "<p>a</p>"), (2, None, None), (4, "u4", ""), (5, "u5", "é" * 9000), (None, "n", "<p>a</p>"), (1, "u1", "<p>a</p>"), (None, "m", "lone")]
    df = spark.createDataFrame([(*p, "x", 3) for p in pages], "page_id long, url string, html string, digest string, payload int")
    got = warc.round_trip(df)
    expect = []
    for i, _, html in pages:
        same = [j for j, _, h in pages if (h or "") == (html or "") and j is not None]
        first = min(same, default=None)
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        expect.append((i, len(body), digest, "response" if i == first else "revisit", None if i == first else first))
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(expect, key=repr)
    records = got.collect()
    assert any(bytes(r.record).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and bytes(r.record).endswith("é".encode() * 9000 + b"\r\n\r\n") for r in records)
    assert all(bytes(r.record).count(b"WARC-Target-URI") <= 1 for r in records)


def test_warc_path_again(spark, tmp_path):
    """One path, written, read, removed and written with other buckets in one session; a payload of many megabytes; no table stays."""
    import shutil

    pages = [(1, "u", "x" * 5_000_000), (2, "u", "x" * 5_000_000), (3, "u", "y")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, rows in (("3", pages), ("5", pages[1:])):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
            got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.read_archive(spark, str(tmp_path / "a")).drop("record").collect()}
            assert got == {k: (len(h), "revisit" if k == 2 and n == "3" else "response") for k, _, h in rows}
            assert len(list((tmp_path / "a").glob(f"payloads-{n}"))) == 1
            shutil.rmtree(tmp_path / "a")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("loomdex_payloads")]


def test_warc_empty_and_damage(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).count() == 0
    warc.write_archive(spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string"), str(tmp_path / "a"))
    name = next((tmp_path / "a").glob("payloads-*")).name
    stored, heads = spark.read.parquet(str(tmp_path / "a" / name)), spark.read.parquet(str(tmp_path / "a/records"))
    stored.selectExpr("digest", "cast('other' as binary) payload", "payload_bytes", "payload_digest", "first_page").write.bucketBy(int(name.split("-")[1]), "digest").option("path", str(tmp_path / "b" / name)).saveAsTable("damaged")
    heads.write.partitionBy("record_type").parquet(str(tmp_path / "b/records"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()
    shutil.copytree(tmp_path / "a" / name, tmp_path / "c" / name)
    wrong = F.encode(F.regexp_replace(F.decode("header", "UTF-8"), "Content-Length: 4", "Content-Length: 3"), "UTF-8")
    heads.withColumn("header", wrong).write.partitionBy("record_type").parquet(str(tmp_path / "c/records"))
    with pytest.raises(Exception, match="differs from its header"):
        warc.read_archive(spark, str(tmp_path / "c")).collect()


# 2. Line dedup


def brute_lines(docs, n):
    first = {}
    key = lambda i: (1, 0) if i is None else (0, i)
    listed = [(i, (t or "").split("\n") if t else []) for i, t in docs]
    for i, ls in listed:
        for p in range(len(ls) - n + 1):
            k = tuple(ls[p : p + n])
            first[k] = min(first.get(k, (key(i), p)), (key(i), p))
    out = []
    for (i, t), (_, ls) in zip(docs, listed, strict=True):
        gone = {q for p in range(len(ls) - n + 1) if first[tuple(ls[p : p + n])] < (key(i), p) for q in range(p, p + n)}
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in gone), len(gone)))
    return out


def test_line_dedup_random(spark, docs):
    many = [(i, "\n".join(RNG.choice("abc") for _ in range(RNG.randrange(12)))) for i in range(60)] + [(r[0], r[1]) for r in DOCS]
    many += [(None, "a\nb\nc\nd"), (200, "a\n" * 3000), (201, None)]
    many = [(i, t) for k, (i, t) in enumerate(many) if (i, t) not in many[:k]]
    df = spark.createDataFrame([(*r, "k") for r in many], "doc_id long, text string, _version string").repartition(5)
    for n, g in ((3, 2), (4, 2), (2, 1), (3, 3)):
        got = linededup.dedup_lines(df, min_run=n, gram=g, removed_as="n")
        assert got.columns == ["doc_id", "text", "_version", "n"]
        by_id = {}
        assert rows(got, "doc_id", "text", "n") == sorted(((i, t, c) for i, t, c in brute_lines(many, n)), key=repr), by_id


def test_line_dedup_empty(none, docs):
    assert linededup.dedup_lines(none).count() == 0
    assert linededup.dedup_lines(docs).count() == len(DOCS)


def test_winnowing_finds_every_shared_window():
    a = np.array([5, 5, 5, 5, 2, 9, 9, 1, 4], np.uint64)
    for w in (1, 2, 3):
        chosen = set(linededup.winnow(a, w).tolist())
        assert all(any(p in chosen and a[p] == a[s : s + w].min() for p in range(s, s + w)) for s in range(len(a) - w + 1))


# 3 and 7. Vectors


def vector_rows(n=400, d=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    out = [(i, [float(v) for v in x[i]]) for i in range(n)]
    out += [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (1060, [0.0] * 8), (1080, [float("inf")] * 8)]
    out += [(2000 + 20 * k, out[3][1]) for k in range(30)] + [(20, out[5][1]), (None, out[7][1]), (2600, [1.0, 2.0, 3.0])]
    return out


def brute_vectors(rows_, k, score, zero):
    ok = [(i, v) for i, v in rows_ if v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    out = []
    for i, q in ok:
        if i is None or i % 20:
            continue
        all_ = [(-score(q, v), j is None, j or 0, j) for j, v in ok if len(v) == len(q) and j != i]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(all_, key=lambda t: t[:3])[:k])]
    return out


def test_topk_exact(spark):
    data = vector_rows()
    df = spark.createDataFrame([(*r, 3, "b") for r in data], "vec_id long, embedding array<double>, dim int, block string").repartition(4)
    score = lambda a, b: int(np.floor(64 * np.array(a)).astype(np.int64) @ np.floor(64 * np.array(b)).astype(np.int64))
    got = topk.top_k(df, block=100, query_block=16)
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(brute_vectors(data, 20, score, True), key=repr)


def test_topk_large_components_and_empty(spark):
    big = [(0, [1e9, -3e8, 2.0]), (1, [1e9, 5.0, 7.0]), (2, [-1e9, 1.0, 1.0]), (20, [1e9, 5.0, 7.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    score = lambda a, b: sum(int(np.floor(64 * x)) * int(np.floor(64 * y)) for x, y in zip(a, b, strict=True))
    clipped = lambda a, b: min(max(score(a, b), -(2**63)), 2**63 - 1)
    assert rows(topk.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(brute_vectors(big, 20, clipped, True), key=repr)
    assert topk.top_k(df.limit(0)).count() == 0
    assert ann.nearest(df.limit(0)).count() == 0


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    data = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    data += [(10_000 + 20 * k, data[40][1]) for k in range(60)] + [(9000, [0.0] * 24), (9020, None), (20, data[41][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(4)
    got = ann.nearest(df, shard=1000).collect()
    expect = brute_vectors(data, 20, lambda a, b: float(np.array(a) @ np.array(b)), False)
    want, have = {}, {}
    for q, _, j, _s in expect:
        want.setdefault(q, []).append(j)
    for r in got:
        have.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(v) for q, v in have.items()} == {q: len(v) for q, v in want.items()}
    assert sum(len(set(want[q]) & set(have[q])) for q in want) >= 0.9 * sum(len(set(v)) for v in want.values())
    vec = {}
    for i, v in data:
        vec.setdefault(i, []).append(v)
    for r in got[:200]:
        assert any(abs(r.score - float(np.dot(a, b))) < 1e-9 for a in vec[r.query_id] for b in vec[r.vec_id])


# 4 and 8. Tokens


@pytest.fixture(scope="module")
def own():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return bpe.codec(*bpe.default_codec()), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(" ab'st\n\t\x1c\x85\xa0é1.,", max_size=60))
def test_bpe_is_the_library(own, t):
    c, library = own
    ids = c.encode(t)
    assert ids.tolist() == library.encode_ordinary(t)
    assert c.decode(ids) == t.encode()


def test_bpe_long_pretoken(own):
    c, library = own
    t = "qwertz" * 5000 + " " + "9" * 3000
    assert c.encode(t).tolist() == library.encode_ordinary(t)


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(5000))


def test_bpe_table(docs, none, own):
    got = bpe.digests(bpe.encode(docs))
    expect = []
    for i, t, *_ in DOCS:
        ids = own[1].encode_ordinary(t or "")
        expect.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expect, key=repr)
    assert bpe.digests(bpe.encode(none)).count() == 0
    once = bpe.encode_decode(docs, keep_ids=True)
    assert rows(once, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expect, key=repr)
    assert rows(once, "doc_id", "ids") == rows(bpe.encode(docs), "doc_id", "ids") and bpe.encode_decode(none).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60) | st.integers(0, 50_000), max_size=700))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, first = tokenfile.pack(x)
    assert (tokenfile.unpack(words, first, len(x)) == x).all()


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    order = sorted(DOCS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    start, expect = 0, []
    for i, t, *_ in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expect.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for size in (3, 100):
        path = str(tmp_path / f"t{size}")
        tokenfile.write_tokens(docs, path, shard_rows=size, block_ids=50)
        assert rows(tokenfile.with_starts(tokenfile.summaries(spark, path), path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expect, key=repr)
        assert {r.doc_id: list(r.ids) for r in tokenfile.read_tokens(spark, path).collect()}[9] == [*library.encode("word", add_special_tokens=False).ids, 1]
    tokenfile.write_tokens(none, str(tmp_path / "none"))
    assert tokenfile.with_starts(tokenfile.summaries(spark, str(tmp_path / "none")), str(tmp_path / "none")).count() == 0


# 5. SimHash


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    fs = sorted(set(fps))
    for a in fs:
        for b in fs:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in fs}


def test_simhash(docs, none):
    fp = {t: brute_fingerprint(t) for _, t, *_ in DOCS}
    comp = brute_components(list(fp.values()))
    ids = {}
    for i, t, *_ in DOCS:
        ids.setdefault(comp[fp[t]], []).append(i)
    expect = [(i, fp[t], min((x for x in ids[comp[fp[t]]] if x is not None), default=None)) for i, t, *_ in DOCS]
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(expect, key=repr)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("pairs_up_to", "cuts"), [(2, 6), (64, 6), (1, 6), (64, 4)])
def test_links_of_random_and_crowded_fingerprints(spark, pairs_up_to, cuts):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for b in base[:40]:
        for _ in range(6):
            x = b
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {base[0] ^ (1 << k) ^ (1 << j) for k in range(12) for j in range(k)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    links = simhash.edges(df, cuts, pairs_up_to)
    assert all(((r.f ^ r.g) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    roots = {r.node & (2**64 - 1): r.root for r in simhash.components(links).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(roots.get(f, signed(f)), set()).add(f)
    expect = {}
    for f, r in brute_components(list(fps)).items():
        expect.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


# 6. Language ID


def test_langid(spark, none):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20))
    data = [(i, make("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz", 9) for i in range(120)]
    data += [(500, None, "aa", 9), (501, "12 !?", "aa", 9), (502, "", None, 9), (None, "abcde bcd", None, 9), (503, "abcde " * 300_000, None, 9), (0, data[0][1], "zz", 9)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score int").repartition(3)
    held = {i for i, *_ in data if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    got = langid.predict(df.select("doc_id", langid.held_out(df.doc_id).alias("held_out"), "text"), langid.train(df)).collect()
    assert {r.doc_id for r in got if r.held_out} == held
    truth = {i: lang for i, _, lang, _ in data if i is not None and i < 120}
    assert all(r.lang_pred == truth[r.doc_id] and 0.9 < r.score <= 1 for r in got if r.doc_id in truth)
    others = {r.doc_id: r.lang_pred for r in got if r.doc_id not in truth}
    assert others == {500: "und", 501: "und", 502: "und", 503: "aa", None: "aa"}
    assert langid.keep_identified(df, langid.train(df)).columns == df.columns
    model = langid.train(none)
    assert model.langs == () and langid.score(["abc"], model) == (["und"], [0.0])


def test_langid_pieces_change_nothing():
    t = text(5000)
    whole, cut = langid.Shape(), langid.Shape(piece=777)
    count = lambda s: np.bincount(np.concatenate(list(langid.features(t, s))), minlength=1 << 16)
    assert (count(whole) == count(cut)).all()


# 9. Mixing


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    size = {}
    for _, t, _, s in DOCS:
        size[s] = size.get(s, 0) + len(words_of(t))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / (sum(weight[s] for s in names if s not in full) or 1)
        over = {s for s in names if s not in full and weight[s] * level > 3 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 3.0 * size[s] if s in full else weight[s] * level for s in names}
    by_source = {}
    source = {i: s for i, _, _, s in DOCS}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        by_source[s] = by_source.get(s, 0) + r.taken
    largest = {s: max(len(words_of(t)) for _, t, _, x in DOCS if x == s) for s in names}
    assert all(abs(by_source[s] - target[s]) <= largest[s] + 1 for s in names)
    assert rows(mixing.mix(docs.repartition(7)), "doc_id", "taken") == rows(mixing.mix(docs), "doc_id", "taken")
    assert mixing.mix(none).count() == 0
    again = mixing.repeat(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got)


# 10. Substring dedup


def brute_windows(docs, n):
    key = lambda i: (1, 0) if i is None else (0, i)
    first = {}
    for i, t in docs:
        w = words_of(t)
        for p in range(len(w) - n + 1):
            k = tuple(w[p : p + n])
            first[k] = min(first.get(k, (key(i), p)), (key(i), p))
    out = []
    for i, t in docs:
        w = words_of(t)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < (key(i), p):
                gone[p : p + n] = True
        out.append((i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def test_substring(spark, docs, none, monkeypatch):
    monkeypatch.setattr(substring, "CELL_BYTES", 4000)
    data = [(i, t) for i, t, *_ in DOCS if t is not LONG] + [(300 + k, text(80) + " " + SHARED + " " + text(40)) for k in range(20)] + [(400, "x " * 500), (401, "y " * 19), (402, ("a b c d e " * 30))]
    df = spark.createDataFrame([(*r, "c") for r in data], "doc_id long, text string, cell string").repartition(4)
    got = substring.remove_repeats(df)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept") == sorted(brute_windows(data, 20), key=repr)
    assert substring.remove_repeats(none).count() == 0
    whole = {(r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(docs).collect()}
    assert (7, 60_000, 60_000) in whole and (3, 0, 0) in whole


def test_bpe_finds_pairs_of_bytes_without_a_lookup_by_part():
    """What two bytes merge into is one place of a list."""
    c = bpe.codec(*bpe.default_codec())
    assert len(c.byte_pairs) == 1 << 16
    for a, b in ((116, 104), (32, 97), (0, 255), (195, 169)):
        assert c.byte_pairs[a << 8 | b] == c.follows[c.byte_id[a]].get(c.byte_id[b], -1)
    assert c.decode(np.array(c.merge("zqxthé".encode()), np.uint32)) == "zqxthé".encode()
