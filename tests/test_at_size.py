"""What only showed on large tables: a digest of many rows, many tosses, places beyond an int."""

import hashlib
from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from loomdex.operators import evaluation, lifecycle


def test_corpus_digest_is_one_definition_at_any_size(spark):
    n = 16 * 65536 + 1  # from here on the digest was folded in other buckets
    each = sorted((hashlib.sha256(str(i).encode()).hexdigest(), hashlib.sha256(str(i % 7).encode()).hexdigest()) for i in range(n))
    buckets = {}
    for o, c in each:
        buckets.setdefault(o[0], []).append(o + c)
    whole = "\n".join(b + hashlib.sha256("\n".join(buckets[b]).encode()).hexdigest() for b in sorted(buckets))
    rows = spark.range(n).select("id", (F.col("id") % 7).alias("c"))
    assert lifecycle.corpus_digest(rows, "id", "c").first().digest == hashlib.sha256(whole.encode()).hexdigest()


def test_corpus_digest_of_nothing(spark):
    assert lifecycle.corpus_digest(spark.range(0).select("id", F.col("id").alias("c")), "id", "c").first().digest == hashlib.sha256(b"").hexdigest()


def test_upper_tail():
    for m, w in ((0, 0), (10, 8), (1000, 490), (1001, 500), (1001, 501), (3000, 1400), (3000, 1560), (3000, 0), (3000, 3000), (20000, 10123), (2000, 1990)):
        exact = Fraction(sum(comb(m, k) for k in range(w, m + 1)), 2**m)
        assert abs(evaluation.upper_tail(m, w) - float(exact)) < 1e-14
    assert abs(evaluation.upper_tail(9_000_001, 4_500_001) - 0.5) < 1e-15  # half of an odd number of tosses, by symmetry
    assert evaluation.upper_tail(9_000_000, 4_600_000) < 1e-100


def test_evenly_of_more_rows_than_an_int_holds_products(spark):
    got = [r.id for r in evaluation.evenly(spark.range(3_000_000), "id", 1000).orderBy("id").collect()]
    assert got == [i * 3_000_000 // 1000 for i in range(1000)]
    assert [r.id for r in evaluation.evenly(spark.range(7), "id", 3).orderBy("id").collect()] == [0, 2, 4]
    assert evaluation.evenly(spark.range(3), "id", 5).count() == 3 and evaluation.evenly(spark.range(0), "id", 5).count() == 0
