"""Exact token counts at every prefix, by dynamic programming (byte-level BPE).

The tokens of a prefix of a word end with exactly one token, and a row of tokens is what
BPE gives if and only if every two neighbours are what BPE gives for their joint bytes.  So
last[i], the closing token of the first i bytes, is the token t ending at i that gets on with
last[i - len(t)], and count[i] = count[i - len(t)] + 1.  One run over a word yields the counts
of all its prefixes; those of a text add up word by word.

``prefix_counts`` answers, for any number of characters, how many tokens the text cut there
has; ``longest_within`` gives the longest cut within a budget.  Neither encodes again.

Null and empty texts have no tokens.  The library's special string counts one token.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing, slices, table

LIMIT = 512


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _blank(c: str) -> bool:
    """White space as the vocabulary's pattern has it: not the four separators of ASCII."""
    return c.isspace() and c not in "\x1c\x1d\x1e\x1f"


class PrefixCounter:
    """Counts tokens of words and of all their prefixes, and remembers them."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        from .vocab import BYTE_WORDS, REMEMBERED, library, path

        own = json.load(open(path(name) if "/" not in name else name, encoding="utf-8"))
        back = {c: b for b, c in byte_names().items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.special = [t["content"] for t in own["added_tokens"]]
        self.vocab = {raw(t): i for t, i in own["model"]["vocab"].items() if t not in self.special}
        self.ranks = {}
        for k, m in enumerate(own["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[raw(a), raw(b)] = k
        self.longest = max(map(len, self.vocab))
        self.tok, self.words, self.most = library(name), BYTE_WORDS, REMEMBERED
        self.back, self.gets_on, self.totals = back, {}, {}

    def bpe(self, word: bytes) -> list[bytes]:
        """The merges applied one by one, lowest rank first: the definition."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fits(self, a: bytes, b: bytes) -> bool:
        """Whether BPE of a + b gives a, b."""
        known = self.gets_on
        if (a, b) not in known:
            if len(known) > 4 * self.most:
                known.clear()
            known[a, b] = self.bpe(a + b) == [a, b]
        return known[a, b]

    def prefixes(self, word: bytes) -> list[int]:
        """count[i] for i from 0 to len(word)."""
        vocab, fits, known = self.vocab, self._fits, self.gets_on
        last, count = [b""], [0]
        for i in range(1, len(word) + 1):
            for at in range(max(0, i - self.longest), i):
                t = word[at:i]
                if t in vocab:
                    before = last[at]
                    if not at or ((before, t) in known and known[before, t]) or ((before, t) not in known and fits(before, t)):
                        last.append(t)
                        count.append(count[at] + 1)
                        break
            else:
                raise AssertionError("no token ends here")
        return count

    def total(self, word: str) -> int:
        found = self.totals.get(word)
        if found is None:
            if len(self.totals) > self.most:
                self.totals.clear()
            found = self.totals[word] = self.prefixes(word.encode())[-1]
        return found

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings, as the library cuts them."""
        from .vocab import UNSAFE

        if not UNSAFE.search(text):
            return self.words.findall(text)
        cuts = [at for _, (at, _) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def _segments(self, text: str) -> list[tuple[str, bool]]:
        out, pattern = [], re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        for k, part in enumerate(pattern.split(text)):
            if part:
                out.append((part, k % 2 == 1))
        return out

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        known, n = self.totals, 0
        for part, special in self._segments(text) if self.special[0] in text else [(text, False)]:
            if special:
                n += 1
                continue
            words = self.split(part)
            try:
                n += sum(map(known.__getitem__, words))
            except KeyError:
                n += sum(map(self.total, words))
        return n

    def prefix_counts(self, text: str | None) -> list[int]:
        """Tokens of ``text[:k]`` for k from 0 to len(text).

        A special string cut short is ordinary text and joins what lies before it, up to the
        special string before; so the counts there come from one run over both.
        """
        out, base, before = [0], 0, ""
        for part, special in self._segments(text or ""):
            if special:
                out += [base + n for n in self._plain_counts(before + part[:-1])[len(before) + 1 :]]
                base += (self._plain_counts(before)[-1] if before else 0) + 1
                out.append(base)
                before = ""
            else:
                out += [base + n for n in self._plain_counts(part)[1:]]
                before = part
        return out

    def _plain_counts(self, text: str) -> list[int]:
        """The counts at the prefixes of a text without special strings.

        A word cut short is a word of the same kind, but for two cases handled apart: a
        contraction cut before its end falls into its apostrophe and letters, and white space
        before a word, cut off from it, joins the white space before.
        """
        out, base, space, before = [0], 0, "", 0
        for word in self.split(text) if text else ():
            counts, step, at = self.prefixes(word.encode()), [], 0
            for c in word:
                at += len(c.encode())
                step.append(counts[at])
            own = [base + c for c in step]
            blank = all(map(_blank, word))
            if space and _blank(word[0]):
                lead = len(word) if blank else 1
                for k in range(lead):  # cut after its blanks, the run of white space is one word
                    own[k] = before + self.prefixes((space + word[: k + 1]).encode())[-1]
            if word[0] == "'" and len(word) == 3 and word[1] in "rvl":
                own[1] = base + 2
            out += own
            base += counts[-1]
            if blank:
                if not space:
                    before = base - counts[-1]
                space += word
            else:
                space, before = "", base
        return out


@functools.cache
def prefix_counter(name: str) -> PrefixCounter:
    """One for each worker process, so that its tasks share what it remembers."""
    return PrefixCounter(name)


def longest_within(counts: list[int], budget: int) -> int:
    """The most characters whose tokens stay within ``budget``."""
    return max(k for k, n in enumerate(counts) if n <= budget)


def _count(batches: Iterator, name: str, limit: int) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    counter = prefix_counter(name)
    for batch in batches:
        n = [counter.count(t) for _, texts in slices(batch, 1) for t in texts]
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pc.cast(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether they pass ``limit``; one pass, no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda it: freeing(_count(it, tokenizer, limit)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _index(batches: Iterator, name: str) -> Iterator:
    import numpy as np
    import pyarrow as pa

    counter = prefix_counter(name)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            steps = [np.diff(counter.prefix_counts(t)).astype("<i2").tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(steps, pa.binary())], ["doc_id", "steps"])


def prefix_index(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id and ``steps``: by how much the count changes with each further character.

    The sum of the first k steps (signed 16-bit little-endian numbers) is the token count of
    the first k characters.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda it: _index(it, tokenizer), "doc_id long, steps binary")


def counts_of(steps: bytes) -> list[int]:
    """The counts at every prefix that ``prefix_index`` stored."""
    import numpy as np

    return [0, *np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64).tolist()]


def query(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
