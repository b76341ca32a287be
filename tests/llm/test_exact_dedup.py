"""Exact dedup: the index and its directory."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quernel.llm import exact_dedup as X

from .helpers import prose, table


def test_directory_splits_until_none_is_overfull():
    rnd = random.Random(1)
    histogram = {rnd.randrange(1 << X.FINEST): rnd.randint(1, 9) for _ in range(3000)}
    depth, slots = X.directory(histogram, 50)
    assert len(slots) == 1 << depth and depth == max(own for _, own in slots)
    sums = defaultdict(int)
    for cell, n in histogram.items():
        sums[slots[cell >> (X.FINEST - depth)]] += n
    assert all(n <= 50 or own == X.FINEST for (_, own), n in sums.items())
    for k, (first, own) in enumerate(slots):
        assert (k << (X.FINEST - depth)) >> (X.FINEST - own) == first >> (X.FINEST - own)
    # no bucket is deeper than it must be: with its brother it is overfull
    for first, own in set(slots):
        if own:
            wide = 1 << (X.FINEST - own + 1)
            assert sum(n for cell, n in histogram.items() if cell // wide == first // wide) > 50
    assert X.directory({}, 5) == (0, [(0, 0)])


def test_capacity_grows_with_the_data():
    assert X.capacity_for(10) == X.CAPACITY and X.capacity_for(1 << 40) == 1 << 27


def test_equals_brute_force(spark):
    texts = [None, ""] + [prose(3 + k % 5, k % 17) for k in range(120)] + ["a ", "a", "A"]
    groups = defaultdict(list)
    for k, t in enumerate(texts, 1):
        groups[t or ""].append(k)
    got = {r.doc_id: r for r in X.exact_dedup(table(spark, texts), capacity=4).collect()}
    for k, t in enumerate(texts, 1):
        own = groups[t or ""]
        assert (got[k].keep_id, got[k].group_size, got[k].kept) == (max(own), len(own), k == max(own))
    index = X.build_index(table(spark, texts), capacity=4)
    assert index.count() == len(groups) and X.chains(index).count() == 0
    assert len({r.bucket for r in index.collect()}) > 3


@pytest.mark.parametrize("hashed", [F.length, lambda t: F.shiftleft(F.xxhash64(t), 62), lambda t: F.lit(0)])
def test_chains_tell_texts_of_one_hash_apart(spark, hashed):
    texts = [None, ""] + [prose(3 + k % 5, k % 17) for k in range(60)] + ["a ", "b ", "a ", "A"]
    number = lambda t: hashed(t).cast("long")
    groups = defaultdict(list)
    for k, t in enumerate(texts, 1):
        groups[t or ""].append(k)
    docs = table(spark, texts).repartition(3)
    got = {r.doc_id: r for r in X.exact_dedup(docs, 4, number).collect()}
    for k, t in enumerate(texts, 1):
        own = groups[t or ""]
        assert (got[k].keep_id, got[k].group_size) == (max(own), len(own))
    index = X.build_index(docs, 4, number)
    assert index.count() == len(groups) and X.chains(index).count() > 0
