"""Secrets: base spans against the patterns themselves; random strings against writing."""

import hashlib
import math
import random
import re
import time

from quernel.llm import secrets

from .helpers import prose, table

KINDS = [
    (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), (re.compile(r"[0-9a-f]+"), 0, 32),
]
NAMES = ("assign", "access", "hex")


def brute(text):
    found = [(m.start(), k, m.end()) for k, (p, group, least) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


def test_base_spans(spark):
    rnd = random.Random(2)
    r = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    texts = [None, "", "password=short token: 'abcdefgh' TOKEN = abcdefghi", "token=token=abcdefgh", "😀 secret:aaaaaaaa" * 3, "AKIA" + "A" * 12, "AKIA" + "A" * 11, "f" * 31 + " " + "0" * 32 + "x" + "a" * 64]
    texts += [" ".join(rnd.choice(["password", "api_key", "APIKEY", ":", "=", "'", '"', r("abc9+/", 9), "AKIA" + r("AZ09", rnd.randint(8, 20)), r("0af", rnd.randint(28, 40)), "é"]) for _ in range(25)).replace(" ", rnd.choice(["", " "])) for _ in range(250)]
    for row in secrets.secrets(table(spark, texts)).collect():
        base = brute(texts[row.doc_id - 1])
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        joined = ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in base)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), texts[row.doc_id - 1]
        assert set(joined.split(",")) - {""} <= set(row.spans.split(","))


def test_random_strings_are_told_from_writing(spark):
    rnd = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_ = [prose(20, k) + " " + "".join(rnd.choice(alphabet) for _ in range(40)) + " " + prose(20, k + 1) for k in range(100)]
    writing = [f"{prose(20, k)} /usr/share/doc/{prose(2, k).replace(' ', '/')}/chapter-2024/index {prose(3, k).replace(' ', '_')}_version_{k}" for k in range(100)]
    got = {r.doc_id: r.n_random for r in secrets.secrets(table(spark, random_ + writing)).collect()}
    assert sum(got[k] == 1 for k in range(1, 101)) >= 90 and sum(got[k] > 0 for k in range(101, 201)) <= 2


def test_random_strings_of_every_alphabet(spark):
    rnd = random.Random(5)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    both = lower + lower.upper()
    base58 = "".join(c for c in both + digits if c not in "0OIl")
    alphabets = [lower + "234567", lower.upper() + "234567", lower + digits, lower.upper() + digits, base58, both, lower, lower.upper(), digits, both + digits]
    texts, where = [], []
    for k, alphabet in enumerate(alphabets):
        for size in (64, 128):
            for n in range(30):
                texts.append(f"{prose(10, n)} {''.join(rnd.choice(alphabet) for _ in range(size))} {prose(10, n + 1)}")
                where.append((k, size))
    writing = [prose(rnd.randint(9, 25), k).replace(" ", "").replace(".", "").replace(",", "").replace("\n", "") for k in range(200)]
    writing += [str(n) * 6 for n in range(1000, 1100)] + ["".join(str(k % 10) for k in range(n, n + 30)) for n in range(100)]
    # long digits are base spans, as hex
    got = {r.doc_id: r.n_random + r.n_hex for r in secrets.secrets(table(spark, texts + writing)).collect()}
    for each in set(where):
        found = [got[k] for k, x in enumerate(where, 1) if x == each]
        assert sum(n == 1 for n in found) >= (0.9 if each[1] == 128 else 0.7) * len(found), (each, sum(found))
    assert sum(got[k] > 0 for k in range(len(texts) + 1, len(texts) + len(writing) + 1)) <= 4


def test_running_sums(spark):
    for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 9000, 270_000):
        got = spark.range(1).selectExpr(f"{secrets._sums(f'transform(sequence(1, {n or 1}), x -> CAST(x % 7 AS BIGINT))' if n else 'CAST(array() AS array<bigint>)')} AS s").first().s
        want, total = [], 0
        for x in range(1, n + 1):
            total += x % 7
            want.append(total)
        assert got == (want or [0])


def test_long_texts_take_time_in_proportion(spark):
    key = "0123456789abcdef" * 2
    took = []
    for n in (1_000_000, 8_000_000):
        texts = ["a " * (n // 4) + key + " " + "token=x " * (n // 16)]
        began = time.perf_counter()
        got = secrets.secrets(table(spark, texts)).first()
        took.append(time.perf_counter() - began)
        assert got.n_hex == 1 and got.spans.startswith(f"hex:{n // 4 * 2}:{n // 4 * 2 + 32}")
    assert took[1] < 60


def test_tail_of_the_normal_distribution(spark):
    zs = [-5.0, -1.0, 0.0, 0.5, 1.0, 2.0, 3.09, 4.5, 6.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").selectExpr(f"{secrets._tail('z')} AS p").collect()
    assert all(abs(r.p - math.erfc(z / 2**0.5) / 2) < 1e-6 for r, z in zip(got, zs, strict=True))
