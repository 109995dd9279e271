"""op13 against a brute-force alignment of whole texts with both libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loomdex.llm import align

SCHEMA = "doc_id long, text string"
NAMES = "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
ODD = [
    (1, "The quick brown fox, don't jump."), (2, "The quick brown fox"), (3, None), (4, ""), (5, " lead"), (6, "trail "), (7, "a  b\tc \n d\n\ne"),
    (8, "Überzählig 東京タワー 😀👍🏽 naïve"), (9, "<|endoftext|> </s> <unk> <0x41> <s>"), (10, " "), (11, "\n"), (12, "a b  c   d \x1c e\u0085 f"), (None, "The quick brown fox"),
    (2, "The quick brown fox"), (14, "x" * 5000), (15, "▁ marks ▁▁ stay"), (16, "\x00 zero"), (17, " ".join(["pneumonoultramicroscopic"] * 3000)), (18, "ﬁ ① Ａ é"),
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = align.byte_letters()
    bytes_a = {k: bytes(letters[c] for c in t) for t, k in a.get_vocab(with_added_tokens=False).items() if letters.keys() >= set(t)}
    pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
    bytes_b = [bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    return a, b, bytes_a, bytes_b


def brute(rows, libraries):
    a, b, bytes_a, bytes_b = libraries
    docs = []
    for doc_id, text in rows:
        found = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            whole = (" " + text).encode()
            if b"".join(bytes_a[k] for k in ids[0]) == whole == b"".join(bytes_b[k] for k in ids[1]):
                at, ends = [], []
                for side, names in zip(ids, (bytes_a, bytes_b), strict=True):
                    e, end = 0, []
                    for k in side:
                        e += len(names[k])
                        end.append(e)
                    ends.append(end)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                start = 0
                for c in cuts:
                    found.append(tuple([k for k, e in zip(ids[s], ends[s], strict=True) if start < e <= c] for s in (0, 1)))
                    start = c
        docs.append((doc_id, found))
    count = Counter()
    for _, found in docs:
        count.update({(x, y) for g, h in found for x in g for y in h})
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for doc_id, found in docs:
        links = [(x, y) for g, h in found for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in found)
        best = sum(count[p] == top[p[0]] for p in links)
        sha = hashlib.sha256(text.encode()).hexdigest() if found else ""
        out.append((doc_id, sum(len(g) for g, _ in found), sum(len(h) for _, h in found), len(found), len(links), best, sum(count[p] for p in links), sha))
    return out


def ordered(rows):
    return sorted(rows, key=str)


def test_odd_texts(spark, libraries):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    assert ordered(tuple(r) for r in align.alignment(docs).collect()) == ordered(brute(ODD, libraries))


def test_documents(spark, libraries):
    """Real rows, in two partitions, so that counts come from several batches."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(2)
    rows = [tuple(r) for r in docs.collect()]
    assert ordered(tuple(r) for r in align.alignment(docs).collect()) == ordered(brute(rows, libraries))


def test_empty_table_and_clashing_names(spark, libraries):
    assert align.alignment(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "one two", 5, "x")], "doc_id long, text string, batch int, part string")
    assert [tuple(r) for r in align.alignment(odd).collect()] == brute([(1, "one two")], libraries)


def test_relational_alignment_of_whole_texts(spark):
    """groups() on documents as they are: (a: 2, 3 and 1 bytes; b: 5 and 1) and a text whose only cut is its end."""
    a = spark.createDataFrame([(1, 0, 10, 2), (1, 1, 11, 3), (1, 2, 12, 1), (2, 0, 10, 2), (2, 1, 11, 2)], "k long, pos int, id int, bytes int")
    b = spark.createDataFrame([(1, 0, 20, 5), (1, 1, 21, 1), (2, 0, 20, 1), (2, 1, 21, 3)], "k long, pos int, id int, bytes int")
    got = {(r.k, r.group): (r.a, r.b) for r in align.groups(a, b, "k").collect()}
    assert got == {(1, 0): ([10, 11], [20]), (1, 1): ([12], [21]), (2, 0): ([10, 11], [20, 21])}


def test_parts_join_to_the_text():
    import pyarrow as pa

    texts = [t for _, t in ODD]
    counts, codes, parts = align.code(pa.array(texts), True)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert " ".join(parts[c] for c in codes[at : at + n]) == (text or "")
        at += n


def test_buckets_follow_the_number_of_parts(spark, libraries, monkeypatch):
    """A task sorts one bucket's tokens, so buckets are as many as the parts ask for, with one file each."""
    made = {}

    def watched(df, tag, key, buckets):
        made[tag] = buckets, (table := bucketed(df, tag, key, buckets))
        return table

    bucketed = align.bucketed
    monkeypatch.setattr(align, "bucketed", watched)
    monkeypatch.setattr(align, "BUCKET_PARTS", 50)
    rows = [(k, " ".join(f"word{(k * 7 + j) % 900}" for j in range(60))) for k in range(100)]
    got = align.alignment(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert ordered(tuple(r) for r in got) == ordered(brute(rows, libraries))
    assert made["tokens"][0] >= 900 // 50 > made["coded"][0]


def test_a_part_meets_its_tokens_once(spark, libraries):
    """Each side's ends meet the other's once, and groups of a part are collected in its own row: no second aggregation and join by group."""
    pair = align.pair(*align.default_paths())
    words = ["fox", "▁", "Überzählig", "", "x" * 50, "東京"]
    assert [len(set(map(len, t))) for t in zip(*(x.to_pylist() for x in pair.tokens(words)[1:3]), strict=True)] == [1] * 6
    assert pair.tokens(words)[0].to_pylist()[:3] == [True, False, True]
    keyed = spark.createDataFrame([(bytes([1]), [10, 11, 12], [2, 5, 6], [20, 21], [5, 6]), (bytes([2]), [10, 11], [2, 4], [20, 21], [1, 4])], "key binary, a array<int>, a_end array<int>, b array<int>, b_end array<int>")
    plan = align.listed(keyed)
    assert {bytes(r.key)[0]: r.listed for r in plan.collect()} == {1: "10,11|20;12|21", 2: "10,11|20,21"}
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("Join") == 3 and shown.count("Aggregate") == 2 and shown.count("Window ") == 2
