"""Token counts and every prefix's count against the library."""

import random

from quernel.llm import token_counts as T
from quernel.llm import vocab

from .helpers import prose, table
from .test_packing import TRICKY

NAME = "byte_bpe_50k.json"


def test_counts_equal_the_library(spark):
    rnd, lib = random.Random(2), vocab.library(NAME)
    texts = [None, *TRICKY, prose(500, 1), "a  b   c\n\n d", " " * 40, "9" * 50, "<|endoftext|>", "x <|endoftext|> y"]
    texts += ["".join(rnd.choice(vocab._PLAIN) for _ in range(50)) for _ in range(200)]
    got = {r.doc_id: r for r in T.token_counts(table(spark, texts)).collect()}
    for k, t in enumerate(texts, 1):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 512), repr(t)


def test_every_prefix(spark):
    rnd, lib = random.Random(3), vocab.library(NAME)
    texts = [*TRICKY, prose(30, 4), "we'll they've I'm it's  x", "a<|endoftext|>b <|endoftext|>", "  two  spaces \n\n x"]
    texts += ["".join(rnd.choice("ab 'slrevm\n1.é") for _ in range(25)) for _ in range(40)]
    steps = {r.doc_id: r.steps for r in T.prefix_index(table(spark, texts)).collect()}
    for k, t in enumerate(texts, 1):
        counts = T.counts_of(steps[k])
        assert counts == [len(lib.encode(t[:n], add_special_tokens=False).ids) for n in range(len(t) + 1)], repr(t)
        cut = T.longest_within(counts, 3)
        assert counts[cut] <= 3 and all(c > 3 for c in counts[cut + 1 :])
