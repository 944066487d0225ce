"""Byte-level BPE by backtracking over longest matches.

The greedy merge loop is quadratic on long words. Here an Aho-Corasick automaton gives the longest
vocabulary entry that starts at each byte; entries are laid left to right, and two neighbours are
accepted only if merging their bytes would stop exactly between them. That test walks the merge
trees of both and is memoised in a pair table. Where no entry fits, the last one is taken back and
its next shorter prefix tried; a bit per position keeps a position from being tried twice, so a
word of n bytes takes O(n) steps.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import regex

#: Fixed value: the published split pattern of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for ASCII; its blanks are those of the other, for `re` takes U+001C to U+001F for blanks too.
_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by id."""
    out: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                word, rank = line.split()
                out[int(rank)] = base64.b64decode(word)
    return [out[i] for i in range(len(out))]


class _Slots(dict):
    """Number of each word in the list of encoded words; a new word is encoded when first asked for."""

    def __init__(self, encode, found: list[list[int]]):
        super().__init__()
        self._encode, self._found = encode, found

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self._found)
        self._found.append(self._encode(word.encode("utf-8", "surrogatepass")))
        return at


class ByteBpe:
    """Encoder and decoder of one vocabulary. ``memo`` bounds the table of words already encoded."""

    def __init__(self, words: list[bytes], memo: int = 400_000):
        self.words = words
        self.ids = {w: i for i, w in enumerate(words)}
        self._memo_size = memo
        self._split: list[tuple[int, int]] = []
        self._pairs: dict[tuple[int, int], int] = {}
        for i, w in enumerate(words):
            left = right = i
            if len(w) > 1:
                for cut in range(1, len(w)):
                    a, b = self.ids.get(w[:cut]), self.ids.get(w[cut:])
                    if a is not None and b is not None and a < i and b < i and self._meets(a, b):
                        left, right = a, b
                        self._pairs[a, b] = i
                        break
                else:
                    raise ValueError(f"entry {i} is no merge of two earlier ones")
            self._split.append((left, right))
        self._auto = ahocorasick.Automaton()
        for i, w in enumerate(words):
            self._auto.add_word(w.decode("latin-1"), i)
        self._auto.make_automaton()
        self._shorter = [self._prefix(w) for w in words]
        self._sizes = [len(w) for w in words]
        self._accepts: dict[int, bool] = {}
        self._wide = regex.compile(PATTERN)
        self._plain = re.compile(_ASCII)
        # decoding: all words end to end, and where each begins
        self._bytes = np.frombuffer(b"".join(words), np.uint8)
        self._starts = np.concatenate([[0], np.cumsum(self._sizes)]).astype(np.int64)
        self.clear()

    def clear(self) -> None:
        """Forget the encoded words; slot 0 stays empty."""
        self._found: list[list[int]] = []
        self._slot = _Slots(self.encode_word, self._found)
        self._each = self._begin = np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.int32)

    def _prefix(self, word: bytes) -> int:
        for n in range(len(word) - 1, 0, -1):
            if (i := self.ids.get(word[:n])) is not None:
                return i
        return -1

    def _meets(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` side by side merge into exactly these two entries."""
        bound, split, pairs = len(self.words), self._split, self._pairs
        while True:
            joint = pairs.get((a, b))
            if joint is not None and joint < bound:
                return False
            if a > b:
                bound, a = a, split[a][1]
                if a == bound:
                    bound, b = b + 1, split[b][0]
                    if b + 1 == bound:
                        return True
            else:
                bound, b = b + 1, split[b][0]
                if b + 1 == bound:
                    bound, a = a, split[a][1]
                    if a == bound:
                        return True

    def encode_word(self, data: bytes) -> list[int]:
        """Ids of one piece of the split pattern."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n, sizes = len(data), self._sizes
        longest = [0] * n
        for end, i in self._auto.iter(data.decode("latin-1")):
            start = end - sizes[i] + 1
            if sizes[i] > sizes[longest[start]] or sizes[i] == 1 and sizes[longest[start]] == 1:
                longest[start] = i
        open_at = bytearray(b"\1") * (n + 1)
        accepts, size, shorter = self._accepts, len(self.words), self._shorter
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + sizes[token]
                if open_at[end]:
                    if last < 0:
                        fits = True
                    else:
                        fits = accepts.get(last * size + token)
                        if fits is None:
                            fits = accepts[last * size + token] = self._meets(last, token)
                    if fits:
                        out.append(token)
                        at = end
                        token = longest[at] if at < n else 0
                        break
                token = shorter[token]
                if token < 0:
                    open_at[at] = 0
                    token = out.pop()
                    at -= sizes[token]
                    break
        if len(accepts) > 4_000_000:
            accepts.clear()
        return out

    def words_of(self, text: str) -> list[str]:
        return (self._plain if text.isascii() else self._wide).findall(text)

    def _slots(self, words: list[str]) -> list[int]:
        slot = self._slot
        return [slot[w] for w in words]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; an empty or null text has none."""
        if not text:
            return []
        if len(self._slot) > self._memo_size:
            self.clear()
        return [i for s in self._slots(self.words_of(text)) for i in self._found[s]]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of many texts, as the buffers of an Arrow list array."""
        if len(self._slot) > self._memo_size:
            self.clear()
        slots: list[int] = []
        ends = [0]
        for t in texts:
            if t:
                slots += self._slots(self.words_of(t))
            ends.append(len(slots))
        if not slots:
            return np.zeros(len(texts) + 1, np.int32), np.zeros(0, np.int32)
        self._extend()
        at = np.asarray(slots, np.int64)
        each = self._each[at]
        total = np.concatenate([[0], np.cumsum(each)])
        index = np.arange(total[-1]) + np.repeat(self._begin[at] - total[:-1], each)
        return total[np.asarray(ends)].astype(np.int32), self._flat[index]

    def _extend(self) -> None:
        """Bring the arrays of encoded words up to date: ids end to end, their number, their begin."""
        new = self._found[len(self._each) :]
        if new:
            size = np.fromiter(map(len, new), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(new), np.int32, int(size.sum()))
            self._begin = np.concatenate([self._begin, len(self._flat) + np.cumsum(size) - size])
            self._each, self._flat = np.concatenate([self._each, size]), np.concatenate([self._flat, flat])

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        if len(self._slot) > self._memo_size:
            self.clear()
        out = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                slots = self._slots(self.words_of(t))
                self._extend()
                out[k] = self._each[slots].sum()
        return out

    def decode(self, ids) -> str:
        """Text of ids, through the table of offsets."""
        ids = np.asarray(ids, np.int64)
        if not ids.size:
            return ""
        start, size = self._starts[ids], self._starts[ids + 1] - self._starts[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(total[-1]) - np.repeat(total[:-1] - start, size)
        return self._bytes[index].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_VOCABULARY) -> ByteBpe:
    """The encoder of a rank file, built once per process."""
    return ByteBpe(read_ranks(path))


_built: dict[str, ByteBpe] = {}


def built(name: str, words: list[bytes]) -> ByteBpe:
    """The encoder of a vocabulary sent along with a task, built once per worker process."""
    if name not in _built:
        _built[name] = ByteBpe(words)
    return _built[name]
