"""Licence scans: planted notices are found where they are, clean texts hold none."""

import random
import re

import pytest

from quernel.llm import licenses

from .helpers import prose, table


def test_planted_notices(spark):
    texts, want = [None, prose(500, 1)], {1: set(), 2: set()}
    for name, own in licenses.TEMPLATES.items():
        for t in own:
            before = prose(700, len(texts)) + "\n"
            texts.append(before + t.upper() + "\n" + prose(300, 5))
            want[len(texts)] = {(name, len(before))}
    got = {r.doc_id: r for r in licenses.license_scan(table(spark, texts)).collect()}
    for k, found in want.items():
        spans = [x.rsplit(":", 2) for x in got[k].spans.split(",") if x]
        starts = {(n, int(a)) for n, a, _ in spans}
        assert found <= starts and got[k].n_notices == len(spans), (texts[k - 1] or "")[-400:]
    assert got[1].n_notices == got[2].n_notices == 0


def test_edited_and_broken_notices(spark):
    words = licenses.TEMPLATES["MIT"][2].split()
    some = words[:40] + ["changed"] + words[41:]
    half = words[: len(words) // 2]
    got = {r.doc_id: r.licenses for r in licenses.license_scan(table(spark, [" ".join(some), " ".join(half), " ".join(half) + prose(60, 1) + " ".join(words[len(half) :])])).collect()}
    assert got[1] == "MIT" and got[2] == ""


def test_short_templates_are_refused():
    with pytest.raises(ValueError):
        licenses.Templates({"x": ["four words are few"]})


WORDS = re.compile(r"[^\W_]+")


def shingles(text):
    w = [x.lower() for x in WORDS.findall(text)]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_containment_by_brute_force(spark):
    """Templates of 5 to 9,000 words, whole, edited and cut, at any place of longer texts."""
    rnd = random.Random(11)
    words = lambda n, k: [f"{x}{rnd.randrange(50)}" for x in WORDS.findall(prose(n, k))][:n]
    templates = {f"t{n}": [" ".join(words(n, n))] for n in (5, 6, 9, 20, 60, 130, 300, 700, 1500, 4000, 9000)}
    texts = []
    for name, (body,) in templates.items():
        own = body.split()
        for share in (0.0, 0.0, 0.02, 0.05, 0.3):
            w = list(own)
            for at in range(len(w)):
                if rnd.random() < share:
                    w[at] = "other"
            texts.append(" ".join(words(rnd.randrange(400), 1) + w + words(rnd.randrange(400), 2)))
        texts.append(" ".join(words(50, 3) + own[: len(own) // 2] + words(50, 4)))
    texts += [prose(300, k) for k in range(10)]
    want = set()
    for k, t in enumerate(texts, 1):
        s = shingles(t)
        for name, (body,) in templates.items():
            b = shingles(body)
            if len(b & s) >= 0.8 * len(b):
                want.add((k, name))
    got = {(r.doc_id, n) for r in licenses.license_scan(table(spark, texts), templates).collect() for n in r.licenses.split(",") if n}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 30
    assert {n for k, n in got} == set(templates)


def test_retrieval_has_the_stated_probability():
    """A template that fills an eighth of its window shares a minimum with it."""
    rnd = random.Random(12)
    found = 0
    for k in range(300):
        body = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(21))  # 17 shingles, in windows of 128
        own = licenses.Templates({"t": [body]})
        text = " ".join([*(f"v{rnd.randrange(10**6)}" for _ in range(150)), body, *(f"v{rnd.randrange(10**6)}" for _ in range(150))])
        found += bool(own.found([text], 0.8)[0])
    assert own.windows == [128] and found >= 298
