"""Exact, cached encoding with a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Before a space that follows none of these, a byte-level BPE's pattern always ends a piece:
#: no alternative of it takes a space after another character than white space.
_UNSAFE = re.compile("[\\s᠎​﻿] ")
#: Strings joined for one call of the library.
_JOINED = 2000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str) -> "UnitEncoder":
    """One encoder for each Python worker; its cache lasts as long as the worker."""
    return UnitEncoder(path)


class UnitEncoder:
    """encode(text) equals Tokenizer.encode(text, add_special_tokens=False).ids.

    A text is cut before each single space that follows a visible character. The library's
    pattern cuts there in any context, so the parts between (units) are encoded alone, each
    distinct unit once while it is in the cache. New units are joined, encoded together and
    taken apart by the byte lengths of the tokens; a cut that no token boundary meets sends
    its units to the library one by one. Texts with runs of white space before a space, or
    with an added token's string, go to the library whole.
    """

    def __init__(self, path: str, cache_units: int = 700_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.width = np.zeros(size, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)  # a byte-level token has one character for each byte
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        for t in self.tok.get_added_tokens_decoder():
            self.width[t] = 0
        self.limit = cache_units
        self.cache: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """By the library, without cuts."""
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """Put the ids of ' ' + unit into the cache."""
        alone, groups, group, size = [], [], [], 0
        for u in units:
            if not u or u[-1].isspace() or u[-1] in "᠎​﻿":
                alone.append(u)
                continue
            group.append(u)
            size += len(u) + 1
            if size > _JOINED:
                groups.append(group)
                group, size = [], 0
        if group:
            groups.append(group)
        for group, e in zip(groups, self.tok.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.asarray(e.ids, self.dtype)
            ends = np.cumsum(self.width[ids])
            cuts = np.cumsum([len(u.encode()) + 1 for u in group])
            at = np.searchsorted(ends, cuts)
            if len(ends) == 0 or at[-1] >= len(ends) or not np.array_equal(ends[at], cuts):
                alone += group
                continue
            raw, w, start = ids.tobytes(), self.dtype.itemsize, 0
            for u, end in zip(group, (at + 1).tolist()):
                self.cache[u] = raw[start * w : end * w]
                start = end
        for u, raw in zip(alone, self.whole([" " + u for u in alone])):
            self.cache[u] = raw

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of self.dtype."""
        if len(self.first) > self.limit // 4:
            self.first.clear()
        cut = [None if _UNSAFE.search(t) or any(a in t for a in self.added) else t.split(" ") for t in texts]
        slow = [t for t, c in zip(texts, cut) if c is None]
        slow_ids = iter(self.whole(slow)) if slow else iter(())
        new: set[str] = set()
        for c in cut:
            if c is not None and len(c) > 1:
                new.update(c[1:])
        if len(self.cache) > self.limit:  # what this batch uses stays
            self.cache = {u: self.cache[u] for u in new if u in self.cache}
        new = [u for u in new if u not in self.cache]
        if new:
            self._learn(new)
        heads = list({c[0] for c in cut if c is not None and c[0] not in self.first})
        if heads:
            self.first.update(zip(heads, self.whole(heads)))
        get, out = self.cache.__getitem__, []
        for c in cut:
            if c is None:
                out.append(next(slow_ids))
            else:
                head = self.first[c[0]]
                c[0] = ""
                tail = map(get, c[1:])
                out.append(b"".join((head, *tail)))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, self.dtype) for b in self.encode_bytes(texts)]


def batches(texts: list, size: int = 4_000_000):
    """Slices of texts of about so many characters, each at least one text."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
