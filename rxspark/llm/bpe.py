"""Encoding and decoding with a word-end BPE vocabulary, in batched numpy merge rounds.

The vocabulary file is one of the ``tokenizers`` library (NFC, white space to one space, lower case; words by pattern;
bytes; merges with ``</w>`` on the last symbol); ids and decoded text are those of the library.  Special tokens
standing in a text are recognised, as the library does by default.

A chunk of texts is one flat array of code points.  Character classes give the word boundaries, a rolling hash names
each word, and a sorted table of known words gives its ids.  New words go through the merge rounds together: their
symbols stand in one flat array, the rank of each neighbouring pair is found by binary search over the sorted pair
keys, and each round merges the lowest-ranked pair of every word.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from .textscan import U, mix, ranges

#: Words kept in a worker's table; beyond it the table starts anew (only speed depends on it).
KNOWN_WORDS = 600_000
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: White space of the library's pattern engine.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_BASE = 0x9E3779B97F4A7C15
_kept: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The encoder of a vocabulary file; one for each worker process."""
    if path not in _kept:
        _kept[path] = Bpe(path)
    return _kept[path]


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[_SPACES] = _SPACE
    return table


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words_of = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.words_of[i] = text
        self.id_texts = [str(i) for i in range(len(self.words_of))]
        letters = _byte_letters()
        self.symbol = np.array([vocab[x] for x in letters], np.int64)
        self.last_symbol = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.shift = int(len(self.words_of)).bit_length()
        keys = left << self.shift | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]
        # All occurrences of a pair may be merged in one round only if no merge needs a symbol that a later one makes.
        when = np.full(len(self.words_of), -1)
        when[made] = np.arange(len(made))
        self.ordered = bool(np.all(np.maximum(when[left], when[right]) < np.arange(len(made)))) and len(np.unique(made)) == len(made)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.classes = _classes()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, U)  # sorted hashes of words
        self.place = np.zeros(0, np.int64)  # their row in starts
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.powers = np.ones(1, U)

    # -- words --------------------------------------------------------------------------------------------------

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case goes by single characters, without the final form
                text = text.replace("Σ", "σ")
        return text.lower()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        pieces, owner, marks = [], [], []
        for i, text in enumerate(texts):
            parts = [text or ""]
            if text and self.split and "<|" in text:
                parts = self.split.split(text)
            for j, part in enumerate(parts):
                if j % 2:
                    marks.append((len(pieces), self.special[part]))
                pieces.append("" if j % 2 else self.normalise(part))
                owner.append(i)
        ids, counts = self._encode(pieces)
        if marks:
            at, tokens = np.array(marks, np.int64).T
            ids = np.insert(ids, (np.cumsum(counts) - counts)[at], tokens.astype(ids.dtype))
            counts[at] = 1
        per = np.bincount(np.array(owner, np.int64), weights=counts, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        chars = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends = self._words(chars, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(pieces), np.int64)
        names = self._names(chars, starts, ends)
        row = self._rows(names, chars, starts, ends)
        counts = self.starts[row + 1] - self.starts[row]
        ids = self.ids[ranges(self.starts[row], counts)]
        first = np.searchsorted(starts, offsets)
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[first[1:]] - total[first[:-1]]

    def _words(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end: letters and other characters run on, a number is a word by itself, white space
        is left out; an apostrophe that starts a word takes one of a few endings with it."""
        n = len(chars)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.classes[chars]
        cut = np.ones(n, bool)  # a word or white space may start here
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        cut[offsets[:-1][offsets[:-1] < n]] = True
        stop = offsets[1:]
        for p in np.flatnonzero((chars == 0x27) & cut).tolist():
            limit = int(stop[np.searchsorted(stop, p, side="right")])
            after = "".join(map(chr, chars[p + 1 : min(p + 3, limit)]))
            for ending in _CONTRACTIONS:
                if after.startswith(ending):
                    cut[p + 1 : p + 1 + len(ending)] = False
                    if p + 1 + len(ending) < n:
                        cut[p + 1 + len(ending)] = True
                    break
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        word = kind[starts] != _SPACE
        return starts[word], ends[word]

    def _names(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        most = int(sizes.max())
        while len(self.powers) < most:
            self.powers = np.concatenate([self.powers, self.powers * U(pow(_BASE, len(self.powers), 2**64))])
        at = ranges(starts, sizes)
        first = np.cumsum(sizes) - sizes
        value = mix(chars + U(1))[at] * self.powers[np.arange(len(at)) - np.repeat(first, sizes)]
        return mix(np.add.reduceat(value, first) ^ (sizes.astype(U) << U(56)))

    def _rows(self, names: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each word in the table, after new words have been added to it."""
        if len(self.known) > KNOWN_WORDS:
            self.forget_words()
        own, where, back = np.unique(names, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, own)
        found = at < len(self.known)
        found[found] = self.known[at[found]] == own[found]
        if not found.all():
            new = where[~found]
            ids, counts = self._merge(["".join(map(chr, chars[a:b])) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            rows = len(self.starts) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
            self.known = np.insert(self.known, at[~found], own[~found])
            self.place = np.insert(self.place, at[~found], rows)
            at = np.searchsorted(self.known, own)
        return self.place[at][back]

    def forget_words(self) -> None:
        powers = self.powers
        self.forget()
        self.powers = powers

    # -- merges -------------------------------------------------------------------------------------------------

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each): every round merges the lowest pair of each word that has one."""
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.symbol[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last_symbol[data[ends]]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_ids, done_words = [], []
        never = len(self.keys)
        while len(symbols):
            pair = symbols[:-1] << self.shift | symbols[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == never] = 0
            fits = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.full(len(symbols), never)
            rank[:-1][fits] = self.rank[at[fits]]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            live = np.repeat(best < never, np.diff(first, append=len(symbols)))
            done_ids.append(symbols[~live])
            done_words.append(word[~live])
            low = np.repeat(best, np.diff(first, append=len(symbols)))
            hit = np.flatnonzero(live & (rank == low))
            if not len(hit):
                break
            # Overlapping occurrences (one symbol repeated): take every second one from the left.
            run = np.append(True, (np.diff(hit) != 1) | (word[hit[1:]] != word[hit[:-1]]))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            if not self.ordered:
                hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            symbols = symbols.copy()
            symbols[hit] = self.made[at[hit]]
            live[hit + 1] = False
            symbols, word = symbols[live], word[live]
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(word, minlength=len(raw))

    # -- decoding -----------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, special tokens included: the file names no decoder."""
        words = self.words_of
        return " ".join([words[i] for i in ids])
