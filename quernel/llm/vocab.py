"""Public tokenizers applied word by word, with results equal to the library's.

A text whose characters all lie in SAFE takes the fast way: a compiled pattern splits it
into the words that the library's own pre-tokenizer would give, and each different word is
tokenized once.  Any other text, and one that holds a special string, goes to the library.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Latin letters and common punctuation: NFC-stable, one meaning in every Unicode version, lower case among them.
_PLAIN = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC, 0x2030, 0x2032, 0x2033, 0x2039, 0x203A]]
_PLAIN = [c for c in _PLAIN if all(x in _PLAIN for x in c.lower())]
_kind = {c: unicodedata.category(c) for c in _PLAIN}
_SPACE = {c for c in _PLAIN if c in "\t\n\x0b\x0c\r \x85\xa0" or _kind[c] in ("Zs", "Zl", "Zp")}


def _ranges(chars) -> str:
    """The inside of a character class, ranges merged."""
    out, codes = [], sorted(map(ord, chars))
    while codes:
        n = 1
        while n < len(codes) and codes[n] == codes[0] + n:
            n += 1
        lo, hi = codes[0], codes[n - 1]
        out.append(f"\\u{lo:04x}" + (f"-\\u{hi:04x}" if hi > lo else ""))
        codes = codes[n:]
    return "".join(out)


L = _ranges(c for c in _PLAIN if _kind[c][0] == "L")
N = _ranges(c for c in _PLAIN if _kind[c][0] == "N")
S = _ranges(_SPACE)
UNSAFE = re.compile(f"[^{_ranges(_PLAIN)}]")
_CUT = "'s|'t|'re|'ve|'m|'ll|'d"
#: Byte-level BPE: every character belongs to a word.
BYTE_WORDS = re.compile(f"{_CUT}| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
#: BPE with word ends: lower case, white space dropped.
END_WORDS = re.compile(f"{_CUT}|[{L}]+|[{N}]|[^{S}{L}{N}]+")

#: Different words that a task remembers before it starts afresh: some 150 bytes each.
REMEMBERED = 800_000


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if os.path.sep in name else path(name))


class WordIds:
    """Ids of whole texts as packed little-endian unsigned 32-bit numbers (word_bpe)."""

    def __init__(self, name: str = "word_bpe_49k.json", remembered: int = REMEMBERED):
        self.tok, self.known, self.most = library(name), {}, remembered
        self.specials = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)")

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        import numpy as np

        return np.array(ids, "<u4").tobytes()

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text, without special tokens added; null is empty."""
        words: list = []
        for t in texts:
            if not t:
                words.append(())
            elif (not t.isascii() and UNSAFE.search(t)) or self.specials.search(t):
                words.append(None)
            else:
                words.append(END_WORDS.findall(t.lower()))
        known = self.known
        if len(known) > self.most:
            known.clear()
        new = list(set().union(*(w for w in words if w)).difference(known))
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = self._pack(e.ids)
        get = known.__getitem__
        return [self._pack(self.tok.encode(t, add_special_tokens=False).ids) if w is None else b"".join(map(get, w)) for t, w in zip(texts, words, strict=True)]


@functools.cache
def word_ids(name: str, remembered: int = REMEMBERED) -> WordIds:
    """One for each worker process, so that its tasks share what it remembers."""
    return WordIds(name, remembered)
