"""Packing and the word-wise tokenizer against the library."""

import random
import zlib

import numpy as np
import pytest

from quernel.llm import packing, vocab

from .helpers import prose, table

NAME = "word_bpe_49k.json"
TRICKY = ["", "It's we'LL I'M 'tis", "a1b22c333 $%& -- ...", "ÀÉİßª ǅ", "x<|endoftext|>y", "tab\tvt\x0bff\x0cnbsp nl\n", "日本語 текст", "\x1c\x1d q\x85w", "é" * 30, "😀", " a—b", "²³ ½ Ⅷ", "\x00"]


def test_words_equal_the_library():
    rnd, own, lib = random.Random(1), vocab.WordIds(NAME), vocab.library(NAME)
    texts = TRICKY + [prose(200, k) for k in range(5)]
    texts += ["".join(rnd.choice(vocab._PLAIN) for _ in range(60)) for _ in range(400)]
    texts += ["".join(rnd.choice("ab '’sStrevmld1. İ") for _ in range(30)) for _ in range(400)]
    for t, got in zip(texts, own.batch(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12_345])
def test_pieces(n):
    cut = packing.pieces(n)
    assert [a for a, _ in cut] == list(np.cumsum([0, *(k for _, k in cut)])[:-1]) and sum(k for _, k in cut) == n
    assert all(k <= 4096 and k & (k - 1) == 0 for _, k in cut) and sum(k < 4096 for _, k in cut) == (n % 4096).bit_count()


def test_round_trip(spark):
    texts = [None, *TRICKY, prose(9000, 1), prose(30, 2)]
    lib = vocab.library(NAME)
    got: dict[int, list] = {}
    rows = packing.pack(table(spark, texts), with_ids=True).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    for k, t in enumerate(texts, 1):
        want = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(got[k], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == want.tobytes()
        assert all(r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes()) for r in own)


def test_buckets_on_disk(spark, tmp_path):
    packed = packing.pack(table(spark, [prose(100, 1), "a"]), with_ids=True)
    packing.write_buckets(packed, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == packed.count() and all(1 << r.bucket == r.length for r in back.select("bucket", "length").collect())
    with pytest.raises(ValueError):
        packing.pack(table(spark, ["a"]), limit=100)
