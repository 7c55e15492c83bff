"""Token ids by pre-tokens: a byte-level BPE encodes each pre-token alone, so ids are kept per distinct pre-token.

Whole batches are split and looked up with numpy. Texts with characters for which numpy's classes are not known to
agree with the tokenizer's go to the tokenizer itself.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np

from curalake.llm.shingles import powers

VOCABULARY = "byte_bpe_50k.json"
#: Slots of the table of known pre-tokens per Python worker (a power of two), and ids kept before it starts anew.
SLOTS = 1 << 18
KEPT_IDS = 1_000_000
#: Characters that are split and looked up at once; a longer text is handled alone.
CHUNK = 250_000

_LETTERS = "A-Za-zªºÀ-ÖØ-öø-ɏ"
#: Characters for which the classes below agree with the tokenizer's: Latin letters, ASCII digits, common signs, white space.
_ODD = re.compile(f"[^\t\n\x0b\x0c\r -~\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf×÷{_LETTERS}‐-‧‰-⁞₠-₿]")
_SHORT = re.compile("'(?:s|t|re|ve|m|ll|d)")
#: The public pattern of this vocabulary's pre-tokenizer, in Python's classes.
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OTHER, _LETTER, _DIGIT, _WHITE = range(4)
_CLASS = np.zeros(0x2100, dtype=np.int8)
for _c in range(len(_CLASS)):
    _CLASS[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdecimal() else _WHITE if chr(_c).isspace() else _OTHER
_rng = np.random.default_rng(20)
_CODE = _rng.integers(1, 1 << 63, size=0x2100, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PreTokenEncoder:
    """Encodes texts as the tokenizer at ``path`` does, without special tokens being added."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.ranks = self._rank_file(os.path.splitext(path)[0] + ".tiktoken")
        self.special = self._special_tokens(path)
        self.small: dict[str, int] = {}
        self._reset()

    @functools.cached_property
    def tokenizer(self):  # noqa: ANN201
        """Loaded when a text needs it: beside the rank file it would be a second vocabulary in every worker."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _special_tokens(path: str) -> list[str]:
        """The added tokens, from their part of the file; the vocabulary is not parsed."""
        with open(path, encoding="utf-8") as file:
            text = file.read()
        at = text.find("[", text.find('"added_tokens"'))
        return [t["content"] for t in json.JSONDecoder().raw_decode(text[at:])[0]]

    @staticmethod
    def _rank_file(path: str):  # noqa: ANN205
        if not os.path.exists(path):
            return None
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _reset(self) -> None:
        self.keys = np.zeros(SLOTS, dtype=np.uint64)
        self.first = np.zeros(SLOTS, dtype=np.int32)
        self.size = np.zeros(SLOTS, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype="<u4")
        self.used = 0

    def plain(self, text: str) -> bool:
        """Whether the pre-token pattern is known to split ``text`` as the tokenizer does."""
        return (text.isascii() and text.isprintable() or not _ODD.search(text)) and not any(s in text for s in self.special)

    def split(self, text: str) -> list[str]:
        return _PRE.findall(text)

    def counts(self, pieces: Sequence[str]) -> list[int]:
        """Ids per pre-token, for a few of them."""
        missing = [p for p in set(pieces) if p not in self.small]
        if missing:
            if len(self.small) > 100_000:
                self.small.clear()
                missing = list(set(pieces))
            for piece, coded in zip(missing, self.tokenizer.encode_batch(missing, add_special_tokens=False), strict=True):
                self.small[piece] = len(coded.ids)
        return [self.small[p] for p in pieces]

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _codes(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pre-tokens, by the vocabulary's rank file where there is one (the same ids, less work per piece)."""
        if self.ranks is not None:
            return [np.array(self.ranks.encode_ordinary(p), dtype="<u4") for p in pieces]
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _split_all(self, points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens of texts that lie one after another in ``points``; no text is empty."""
        kind = _CLASS[points]
        white = kind == _WHITE
        start = np.empty(len(points), dtype=bool)
        start[0] = True
        start[1:] = np.where(white[1:], ~white[:-1], (kind[1:] != kind[:-1]) & (points[:-1] != 32))
        before = white[:-1] & ~white[1:]
        start[:-1] |= before
        # text borders: what stands before or behind in another text does not count
        last = ends - 1
        alone = last[white[last] & (last > begins)]
        start[alone] = ~white[alone - 1]
        start[begins] = True
        return np.flatnonzero(start)

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For plain, non-empty texts without shortened words: starts and lengths of pre-tokens in code points, first id and
        number of ids of each in ``self.flat``, and the index of each text's first pre-token (and the end)."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        starts = self._split_all(points, begins, ends)
        lengths = np.diff(starts, append=len(points))
        place = np.arange(len(points)) - np.repeat(starts, lengths)
        hashes = np.add.reduceat(_CODE[points] * powers(int(lengths.max()))[place], starts) + lengths.astype(np.uint64)
        hashes |= np.uint64(1)
        slot = (hashes >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        other = (hashes >> np.uint64(11)).astype(np.int64) & (SLOTS - 1)
        slot = np.where(self.keys[slot] == hashes, slot, other)
        miss = np.flatnonzero(self.keys[slot] != hashes)
        first, size = self.first[slot], self.size[slot]
        if len(miss):
            fresh, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            joined = "".join(texts)
            pieces = [joined[a : a + n] for a, n in zip(starts[miss[at]].tolist(), lengths[miss[at]].tolist(), strict=True)]
            codes = self._codes(pieces)
            n = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes))
            total = int(n.sum())
            if self.used + total > KEPT_IDS and self.used:
                self._reset()
                return self.encode_plain(texts)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + total] = np.concatenate(codes)
            offsets = self.used + np.cumsum(n) - n
            self.used += total
            one = (fresh >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
            two = (fresh >> np.uint64(11)).astype(np.int64) & (SLOTS - 1)
            goes = np.where(self.keys[one] == 0, one, two)
            self.keys[goes] = fresh
            self.first[goes] = offsets
            self.size[goes] = n
            held = self.keys[goes] == fresh  # of two that meet in a slot the later one stays
            keep = goes[held]
            self.first[keep], self.size[keep] = offsets[held], n[held]
            first[miss], size[miss] = offsets[back], n[back]
        return starts, lengths, first, size, np.append(np.searchsorted(starts, begins), len(starts))

    @staticmethod
    def chunks(texts: Sequence[str | None], chosen: list[int]) -> Iterator[list[int]]:
        chunk: list[int] = []
        held = 0
        for i in chosen:
            if chunk and held + len(texts[i]) > CHUNK:
                yield chunk
                chunk, held = [], 0
            chunk.append(i)
            held += len(texts[i])
        if chunk:
            yield chunk

    def ids_of(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts; null counts as empty."""
        out = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if text:
                if self.plain(text) and not ("'" in text and _SHORT.search(text)):
                    plain.append(i)
                else:
                    out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        for plain in self.chunks(texts, plain):
            _, _, first, size, bounds = self.encode_plain([texts[i] for i in plain])
            upto = np.cumsum(size, dtype=np.int64)
            place = np.arange(upto[-1]) + np.repeat(first - (upto - size), size)
            data = self.flat[place].tobytes()
            cuts = np.append(0, upto)[bounds] * 4
            for k, i in enumerate(plain):
                out[i] = data[cuts[k] : cuts[k + 1]]
        return out


def encoder(path: str, known: dict[str, PreTokenEncoder] = {}) -> PreTokenEncoder:  # noqa: B006  one per Python worker, kept between tasks
    if path not in known:
        known[path] = PreTokenEncoder(path)
    return known[path]
