"""Byte-pair vocabularies and vectorised merging, shared by operators 3 and 4.

A pre-token is a sequence of initial symbols. Merging is rank-synchronous: in each
round every sequence of a ragged batch applies its own lowest-rank pair at all of
its places, left to right. That equals merging one place at a time because a
merge's rank is above the ranks that make its parts and every product has one
merge (both are checked when a vocabulary is loaded).
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

NONE = np.int64(1 << 62)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: a printable Latin-1 one is itself, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    shifted = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(shifted.get(b, b)) for b in range(256)]


def ragged_index(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i], ..., starts[i] + sizes[i] - 1 of all rows, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """A BPE model of a tokenizers file with byte-level symbols and an optional word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for text, k in [*ids.items(), *self.special.items()]:
            self.tokens[k] = text
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.final = np.array([ids[c + self.suffix] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        rank = np.full(len(self.tokens), -1, dtype=np.int64)
        rank[made] = np.arange(len(pairs))
        if len(np.unique(made)) != len(made) or not (np.maximum(rank[left], rank[right]) < np.arange(len(made))).all():
            raise ValueError("merges of this vocabulary can't be applied in synchronous rounds")
        order = np.argsort(left << 32 | right)
        self.keys, self.ranks = (left << 32 | right)[order], order.astype(np.int64)
        self.left, self.right, self.made, self.rank_of = left, right, made, rank
        blob = [t.encode() for t in self.tokens]
        self.text_bounds = np.concatenate([[0], np.cumsum([len(b) for b in blob])])
        self.text = np.frombuffer(b"".join(blob), dtype=np.uint8)

        # the initial symbols of each token, ragged
        spelled: list[list[int]] = [[k] for k in range(len(self.tokens))]
        for a, b, m in zip(left.tolist(), right.tolist(), made.tolist()):
            spelled[m] = spelled[a] + spelled[b]
        self.spelled_size = np.array([len(x) for x in spelled], dtype=np.int64)
        self.spelled_start = np.cumsum(self.spelled_size) - self.spelled_size
        self.spelled = np.fromiter((s for x in spelled for s in x), dtype=np.int64, count=int(self.spelled_size.sum()))

    def symbols(self, pieces: list[bytes], final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces, and their bounds; the last of a piece is a word's last where ``final``."""
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        out = self.inner[raw]
        last = bounds[1:][final] - 1
        out[last] = self.final[raw[last]]
        return out, bounds

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ragged symbol sequences to ragged token sequences, in rank-synchronous rounds."""
        n = len(bounds) - 1
        done_ids, done_seq = [], []
        seq = np.repeat(np.arange(n), np.diff(bounds))
        sym = flat.astype(np.int64)
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            rank[:-1] = np.where(seq[1:] == seq[:-1], self.pair_ranks(sym[:-1], sym[1:]), NONE)
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            lowest = np.minimum.reduceat(rank, heads)
            size = np.diff(np.append(heads, len(sym)))
            alive = np.repeat(lowest < NONE, size)
            if not alive.all():
                done_ids.append(sym[~alive]), done_seq.append(seq[~alive])
                sym, seq, rank, lowest, size = sym[alive], seq[alive], rank[alive], lowest[lowest < NONE], size[lowest < NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            # in a run such as a a a the pairs overlap: every other one counts, from the left
            first = np.concatenate([[True], np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            where = np.cumsum(keep) - 1
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            new = where[at]
            touched = np.zeros(len(sym), dtype=bool)
            touched[new] = True
            touched[new[new > 0] - 1] = True
            new = np.flatnonzero(touched)
            nxt = np.minimum(new + 1, len(sym) - 1)
            rank[new] = np.where((seq[nxt] == seq[new]) & (nxt > new), self.pair_ranks(sym[new], sym[nxt]), NONE)
        ids = np.concatenate(done_ids) if done_ids else np.empty(0, np.int64)
        seq = np.concatenate(done_seq) if done_seq else np.empty(0, np.int64)
        order = np.argsort(seq, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n))])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once a worker."""
    return Vocabulary(path)


def join_leaves(vocab: Vocabulary, ids: np.ndarray, word: np.ndarray, bounds: np.ndarray, text_of: np.ndarray, window: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Tree concatenation of encoded leaves: tokens with their word's number, bounds of leaves, and the text of each leaf,
    to the texts' tokens and bounds. Neighbouring halves are joined level by level, all texts at once.

    A join re-encodes the last k tokens of its left side and the first k of its right side, word borders included; when
    the first new token is the left side's and the last is the right side's (or the text's part ends there), what lies
    outside is unaffected and the new tokens replace the window, else k doubles. A token sequence is the encoding of its
    text exactly if every two neighbouring tokens of a word encode to themselves, and each such pair of the result lies
    inside the left side, the window or the right side.
    """
    while True:
        leaf = np.arange(len(text_of))
        head = np.maximum.accumulate(np.where(np.concatenate([[True], text_of[1:] != text_of[:-1]]), leaf, 0)) if len(leaf) else leaf
        left = np.flatnonzero((text_of[1:] == text_of[:-1]) & ((leaf - head)[:-1] % 2 == 0))
        if not len(left):
            return ids, bounds
        at, low, high = bounds[left + 1], bounds[left], bounds[left + 2]
        k = np.full(len(left), window)
        start, size = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        new_ids, new_words, made, todo = [], [], 0, np.arange(len(left))
        while len(todo):
            a, b = np.maximum(at - k, low)[todo], np.minimum(at + k, high)[todo]
            index = ragged_index(a, b - a)
            n = vocab.spelled_size[ids[index]]
            symbols = vocab.spelled[ragged_index(vocab.spelled_start[ids[index]], n)]
            join, of = np.repeat(np.repeat(np.arange(len(todo)), b - a), n), np.repeat(word[index], n)
            edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (join[1:] != join[:-1])]))
            got, ends = vocab.merge(symbols, np.append(edge, len(symbols)))
            each = np.bincount(np.repeat(join[edge], np.diff(ends)), minlength=len(todo))
            stop = np.cumsum(each)
            fine = ((a == low[todo]) | (got[stop - each] == ids[a])) & ((b == high[todo]) | (got[stop - 1] == ids[b - 1]))
            start[todo], size[todo] = made + stop - each, each
            new_ids.append(got), new_words.append(np.repeat(of[edge], np.diff(ends)))
            made += len(got)
            todo = todo[~fine]
            k[todo] *= 2
        # what is outside the windows and the windows' new tokens, in turn
        a, b = np.maximum(at - k, low), np.minimum(at + k, high)
        source = np.concatenate([[0], np.stack([len(ids) + start, b], axis=1).ravel()])
        amount = np.concatenate([[a[0]], np.stack([size, np.append(a[1:], len(ids)) - b], axis=1).ravel()])
        index = ragged_index(source, amount)
        ids, word = (np.concatenate([old, *new])[index] for old, new in ((ids, new_ids), (word, new_words)))
        shift = np.concatenate([[0], np.cumsum(size - (b - a))])
        bounds = bounds + shift[np.searchsorted(b, bounds, side="right")]
        gone = np.zeros(len(bounds), dtype=bool)
        gone[left + 1] = True
        bounds, text_of = bounds[~gone], text_of[~gone[:-1]]


def _ranges(codes: list[int]) -> str:
    """A character class body of code points."""
    out, at = [], 0
    while at < len(codes):
        to = at
        while to + 1 < len(codes) and codes[to + 1] == codes[to] + 1:
            to += 1
        out.append(f"\\U{codes[at]:08x}-\\U{codes[to]:08x}")
        at = to + 1
    return "".join(out)


# fixed values: letters, numbers and lower-case pairs that the library knows and Python's tables may not have yet
NEW_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEW = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in [(0x1C89, 0x1C89), (0xA7CB, 0xA7DC), (0x10D50, 0x10D65), (0x16EA0, 0x16EB8)]) + "]")


# fixed values: marks added to Unicode after the library's tables of order and composition; it leaves them where they stand, and others don't move past them
LATE_MARKS = [(0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C),
    (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1),
    (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF)]
_LATE = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATE_MARKS) + "])")


def composed(text: str) -> str:
    """NFC as the library's tables have it: what stands between late marks is normalised on its own."""
    if unicodedata.is_normalized("NFC", text):  # so are all its parts
        return text
    if _LATE.search(text):
        return "".join(unicodedata.normalize("NFC", part) for part in _LATE.split(text))
    return unicodedata.normalize("NFC", text)


def _pattern(below: int) -> re.Pattern:
    """Contractions, runs of letters, single numbers, and runs of what is neither nor white space."""
    kinds: dict[str, list[int]] = {"L": [], "N": []}
    for c in range(below):
        if (kind := unicodedata.category(chr(c))[0]) in kinds:
            kinds[kind].append(c)
    for kind, new in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
        kinds[kind] = sorted({*kinds[kind], *(c for a, b in new for c in range(a, b + 1) if c < below)})
    space = _ranges([*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    letter, number = _ranges(kinds["L"]), _ranges(kinds["N"])
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


#: Small classes are faster; texts with a character beyond them take the full pattern.
_LATIN, _BEYOND, _FULL = _pattern(0x250), re.compile(r"[^\x00-ɏ]"), []


def split_words(text: str) -> list[str]:
    """Normalised pre-tokens (NFC, lower case, white space dropped) of a text without special strings."""
    if not text.isascii():
        text = composed(text).replace("Σ", "σ")
        if _NEW.search(text):
            text = text.translate(NEW_LOWER)
    text = text.lower()
    if text.isascii() or not _BEYOND.search(text):
        return _LATIN.findall(text)
    if not _FULL:
        _FULL.append(_pattern(0x110000))
    return _FULL[0].findall(text)


class Words:
    """Encodings of distinct pre-tokens, kept over the blocks of a task up to ``most`` of them."""

    def __init__(self, vocab: Vocabulary, encode, most: int = 400_000):
        self.vocab, self.encode, self.most = vocab, encode, most
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self.clear()

    def clear(self) -> None:
        self.at = {t: k for k, t in enumerate(self.vocab.special)}
        self.ids = np.array(list(self.vocab.special.values()), dtype=np.int64)
        self.bounds = np.arange(len(self.at) + 1)
        self.size = np.array([len(t.encode()) for t in self.vocab.special], dtype=np.int64)

    def words(self, text: str) -> list[str]:
        if self.split and "<|" in text:
            out = []
            for k, part in enumerate(self.split.split(text)):
                out += [part] if k % 2 else split_words(part)
            return out
        return split_words(text)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Of all words of all texts: their place in this table, where each text begins, and the words."""
        if len(self.at) > self.most:
            self.clear()
        split = [self.words(t) for t in texts]
        flat = [w for words in split for w in words]
        new = list(set(flat).difference(self.at))
        if new:
            coded = [w.encode("utf-8") for w in new]
            ids, bounds = self.encode(coded)
            self.size = np.concatenate([self.size, [len(w) for w in coded]])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
            self.ids = np.concatenate([self.ids, ids])
        return np.fromiter(map(self.at.__getitem__, flat), dtype=np.int64, count=len(flat)), np.concatenate([[0], np.cumsum([len(x) for x in split])]), flat


def encode_words(vocab: Vocabulary, words: list[bytes], most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of whole words, ragged. Words of more than ``most`` bytes are cut and joined again, as rounds over one long sequence would be many."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    parts = np.maximum(1, -(-size // most))
    cuts = [size[w] * k // parts[w] for w, k in zip(np.repeat(np.arange(len(words)), parts).tolist(), ragged_index(np.zeros(len(words), np.int64), parts).tolist())]
    of = np.repeat(np.arange(len(words)), parts)
    stops = [*cuts[1:], 0]
    last = np.append(of[1:] != of[:-1], True)
    pieces = [words[w][a : len(words[w]) if end else b] for w, a, b, end in zip(of.tolist(), cuts, stops, last.tolist())]
    ids, bounds = vocab.merge(*vocab.symbols(pieces, last))
    return join_leaves(vocab, ids, np.repeat(of, np.diff(bounds)), bounds, of)
