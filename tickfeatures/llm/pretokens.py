"""Pre-tokens of a byte-level BPE tokenizer, for many texts at once.

A tokenizer file of this family cuts a text at its special tokens, then into
pre-tokens by the pattern ::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and merges bytes inside each pre-token only. The ids of a text are therefore the ids of
its pre-tokens in order, and equal pre-tokens have equal ids: ``WordCache`` keeps the ids
of pre-tokens by hash and asks an encoder only for those it has not seen, in bounded
memory.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from .text import code_hashes, span_hashes

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
# fixed values: Unicode White_Space
WHITE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
# fixed values: the endings that the pattern keeps with their apostrophe
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """What the encoder and decoder need of a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        pre = spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        to_byte = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.byte_id = np.array([ids[c] for c in letters], np.int32)
        self.spelled = [b""] * self.size
        for token, i in ids.items():
            self.spelled[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.spelled[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, read once in each Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([UNKNOWN if (k := unicodedata.category(chr(c))) == "Cn" else kinds.get(k[0], OTHER) for c in range(0x110000)], np.uint8)
    table[list(WHITE)] = SPACE
    return table


class Splitter:
    """Cuts texts into pre-tokens. Code points that Python's tables do not assign yet are
    looked up in the tokenizer itself."""

    def __init__(self, path: str):
        self._table = _class_table()
        self._library = Tokenizer.from_file(path).pre_tokenizer

    def _classes(self, points: np.ndarray) -> np.ndarray:
        kinds = self._table[points]
        if (kinds == UNKNOWN).any():
            for c in np.unique(points[kinds == UNKNOWN]).tolist():
                joined = {len(self._library.pre_tokenize_str(x + chr(c) + x)) == 1: kind for x, kind in (("1", NUMBER), ("a", LETTER))}
                self._table[c] = joined.get(True, OTHER)
            kinds = self._table[points]
        return kinds

    def starts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """True at the first code point of every pre-token; offsets delimit the texts."""
        n = len(points)
        kinds = self._classes(points)
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        first = first[:n]
        change = first.copy()
        change[1:] |= kinds[1:] != kinds[:-1]
        space = kinds == SPACE
        start = change.copy()
        last = np.ones(n, bool)  # last code point of its text
        last[:-1] = first[1:]
        # white space before a word: its last code point is a token of its own, or joins the word if it is a blank
        edge = np.zeros(n, bool)
        edge[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
        start |= edge
        joins = np.flatnonzero(edge & (points == 0x20))
        start[joins + 1] = False
        self._endings(points, kinds, first, start)
        return start

    @staticmethod
    def _endings(points: np.ndarray, kinds: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
        n = len(points)
        at = np.flatnonzero((points == 0x27) & start)
        for i in at.tolist():  # apostrophes that begin a token
            if i + 1 >= n or first[i + 1] or kinds[i + 1] != LETTER:
                continue
            if chr(points[i + 1]) in ENDINGS_1:
                end = i + 2
            elif i + 2 < n and not first[i + 2] and chr(points[i + 1]) + chr(points[i + 2]) in ENDINGS_2:
                end = i + 3
            else:
                continue
            start[i + 1 : end] = False
            if end < n:
                # letters that follow begin a token; after white space etc. the mark is there already
                start[end] |= first[end] or kinds[end] == LETTER


class WordCache:
    """Ids of pre-tokens by 64-bit hash, in sorted arrays. ``limit`` bounds the pre-tokens
    kept; when it is passed the cache starts anew."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1_500_000):
        self._encode, self._limit = encode, limit
        self._reset()

    def _reset(self) -> None:
        self._keys, self._slot = np.empty(0, np.uint64), np.empty(0, np.int32)
        self._offsets, self._ids = np.zeros(1, np.int64), np.empty(0, np.int32)

    def lookup(self, hashes: np.ndarray, spell: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pre-tokens in order, and the number of ids of each."""
        codes, distinct = pd.factorize(hashes)
        if len(self._keys) > self._limit:
            self._reset()
        slot = np.full(len(distinct), -1, np.int32)
        if len(self._keys):
            at = np.minimum(np.searchsorted(self._keys, distinct), len(self._keys) - 1)
            known = self._keys[at] == distinct
            slot[known] = self._slot[at[known]]
        new = np.flatnonzero(slot < 0)
        if len(new):
            example = np.empty(len(distinct), np.int64)
            example[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            ids, lengths = self._encode(spell(example[new]))
            slot[new] = np.arange(len(new)) + len(self._offsets) - 1
            self._offsets = np.concatenate([self._offsets, self._offsets[-1] + np.cumsum(lengths)])
            self._ids = np.concatenate([self._ids, ids])
            keys = np.concatenate([self._keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self._keys, self._slot = keys[order], np.concatenate([self._slot, slot[new]])[order]
        token = slot[codes]
        begin = self._offsets[token]
        length = self._offsets[token + 1] - begin
        return self._ids[ranges(begin, length)], length


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of arange(b, b + n) for each pair."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total, dtype=np.int64) + np.repeat(begin - (ends - length), length)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str, make: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]]) -> Encoder:
    """This worker's encoder of the file; tasks of a reused worker share its word cache."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, make())
    return _encoders[path, kind]


class Encoder:
    """Whole texts to ids, special tokens of the file included (add_special_tokens=False)."""

    def __init__(self, path: str, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], piece_chars: int = 2_000_000):
        self.vocabulary = vocabulary(path)
        self._splitter = Splitter(path)
        self._cache = WordCache(encode_words)
        self._piece = piece_chars

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of rows of bounded size: number of rows, flat ids, ids of each row."""
        run: list[str] = []
        size = 0
        for t in texts:
            run.append(t or "")
            size += len(run[-1])
            if size >= self._piece:
                yield len(run), *self._run(run)
                run, size = [], 0
        if run:
            yield len(run), *self._run(run)

    def _run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # cut at special tokens: parts alternate plain text and special token
        parts, row, special = [], [], []
        for i, t in enumerate(texts):
            for part, token in cut(t, self.vocabulary.special):
                parts.append(part)
                row.append(i)
                special.append(token)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(self._splitter.starts(points, offsets)) if len(points) else np.empty(0, np.int64)
        ends = np.append(at[1:], len(points))[: len(at)]
        hashes = span_hashes(code_hashes(points), at, ends)

        def spell(tokens: np.ndarray) -> list[str]:
            return [whole[a:b] for a, b in zip(at[tokens].tolist(), ends[tokens].tolist(), strict=True)]

        ids, n = self._cache.lookup(hashes, spell) if len(at) else (np.empty(0, np.int32), np.empty(0, np.int64))
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        per_part = np.diff(total[np.searchsorted(at, offsets)])
        tokens = np.array(special, np.int32)
        row = np.array(row, np.int64)
        if (tokens >= 0).any():
            ids = np.insert(ids, np.cumsum(per_part)[tokens >= 0], tokens[tokens >= 0])
            per_part = per_part + (tokens >= 0)
        return ids, np.bincount(row, weights=per_part, minlength=len(texts)).astype(np.int64)


def cut(text: str, special: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(plain text, id of the special token behind it or -1), leftmost and longest first."""
    at = 0
    while special:
        found = [(i, -len(s), s) for s in special if (i := text.find(s, at)) >= 0]
        if not found:
            break
        i, _, token = min(found)
        yield text[at:i], special[token]
        at = i + len(token)
    yield text[at:], -1
