"""Ids of a word-end BPE tokenizers file for whole columns of texts, without a Python object per word.

The rules of such a file never look across a space or a line break, so a column is cut there and each distinct word is encoded
once per step. Words of Latin letters, with marks behind them or not, are merged together in numpy: all rows advance by their
best merge at once. All others go to the tokenizers library, with which some hundred strings are compared when a file is opened.
"""

from __future__ import annotations

import json
import os
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in one step; longest word in bytes that is merged here; rows merged at once.
STEP_BYTES, LONGEST, ROWS = 12 << 20, 24, 1 << 16
_NO = np.int32(1 << 30)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _probes(count: int = 400) -> list[str]:
    """Strings over letters, marks, digits, spaces and all of Unicode, always the same ones."""
    rng = random.Random(1)
    parts = ["a", "The", "É", "ß", "ñ", "İ", "œ", "Ÿ", "×", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "...", "!?", "_", "-", "ing", "ABC", "<|endoftext|>", "\u0301", "\u00a0", "\u200b"]
    point = lambda: chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000))))
    return ["".join(rng.choice(parts) if rng.random() < 0.7 else point() for _ in range(rng.randrange(1, 30))) for _ in range(count)]


class WordTokenizer:
    """Batch encoder for one tokenizers file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        # Two hash tables: a pair that finds its slot taken goes to the second one, and on until none is left.
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        left = np.arange(len(keys))
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
            if not len(left):
                break
            slot = self._slot(keys[left], np.uint64(factor))
            _, first = np.unique(slot, return_index=True)
            key, rank = np.full(1 << 19, -1, np.int64), np.full(1 << 19, _NO, np.int32)
            key[slot[first]], rank[slot[first]] = keys[left[first]], left[first]
            self.tables.append((np.uint64(factor), key, rank))
            left = np.delete(left, first)
        if len(left):
            raise ValueError("merges do not fit the tables")
        probes = ["It's 12\ntést  <|endoftext|> ÉÀ... Größe, ×÷", "a\n b", *_probes()]
        if [x.tolist() for x in self.encode(pa.array(probes))] != [e.ids for e in self.lib.encode_batch(probes, add_special_tokens=False)]:
            raise ValueError("this tokenizer's rules cross spaces, or its words are not merged as here")

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * factor) >> np.uint64(45)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        out = np.full(len(keys), _NO, np.int32)
        for factor, key, rank in self.tables:
            slot = self._slot(keys, factor)
            np.copyto(out, rank[slot], where=key[slot] == keys)
        return out

    def _merge(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of symbols (padded): the ids of all rows, and their number in each."""
        n, w = symbols.shape
        flat = symbols.reshape(-1)
        place = np.arange(w)
        alive = (place < length[:, None]).reshape(-1)
        ranks = np.full(n * w, _NO, np.int32)
        pair = np.flatnonzero((place + 1 < length[:, None]).reshape(-1))
        ranks[pair] = self._rank(flat[pair], flat[pair + 1])
        after, before = np.tile(place + 1, n), np.tile(place - 1, n)
        rows = np.arange(n)
        grid = ranks.reshape(n, w)
        while len(rows):
            at = grid[rows].argmin(axis=1)
            best = grid[rows, at]
            go = best < _NO
            rows, at, best = rows[go], at[go], best[go]
            if not len(rows):
                break
            base = rows * w
            j = base + at
            k = base + after[j]
            new = self.made[best]
            flat[j] = new
            alive[k] = False
            ranks[k] = _NO
            nxt = after[k]
            after[j] = nxt
            more = nxt < length[rows]
            ranks[j] = _NO
            jm, nm = j[more], base[more] + nxt[more]
            before[nm] = at[more]
            ranks[jm] = self._rank(new[more], flat[nm])
            p = before[j]
            had = p >= 0
            pm = base[had] + p[had]
            ranks[pm] = self._rank(flat[pm], new[had])
        return flat[alive], alive.reshape(n, w).sum(axis=1)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the number of ids of each."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]].copy()
        size = np.diff(offsets)
        upper = (data >= 65) & (data <= 90)
        data[upper] += 32
        letter = (data >= 97) & (data <= 122)
        lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
        follow = data[lead + 1]
        good = (follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)
        lead, follow = lead[good], follow[good]
        letter[lead] = letter[lead + 1] = True
        data[lead[follow <= 0x9E] + 1] += 32
        mark = (data > 32) & (data < 127) & ~letter & ~((data >= 48) & (data <= 57))
        count = lambda m: np.diff(np.r_[0, np.cumsum(m)][offsets])
        letters, marks = count(letter), count(mark)
        start = np.flatnonzero(size > 0)
        turn = np.zeros(len(data), bool)  # letters behind marks
        turn[1:] = letter[1:] & ~letter[:-1]
        turn = np.r_[0, np.cumsum(turn)]
        turns = np.zeros(n, np.int64)
        turns[start] = turn[offsets[start + 1]] - turn[offsets[start] + 1]
        easy = (letters + marks == size) & (turns == 0) & (letters <= LONGEST) & (marks <= LONGEST)
        firsts = np.flatnonzero(easy & (letters > 0))
        seconds = np.flatnonzero(easy & (marks > 0))
        owner = np.concatenate([firsts, seconds]) * 2 + np.repeat([0, 1], [len(firsts), len(seconds)])
        begin = np.concatenate([offsets[firsts], offsets[seconds] + letters[seconds]])
        length = np.concatenate([letters[firsts], marks[seconds]])
        counts = np.zeros(2 * n, np.int64)
        found: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        order = np.argsort(length, kind="stable")
        for a in range(0, len(order), ROWS):
            at = order[a : a + ROWS]
            k = length[at]
            w = int(k[-1])
            where = np.minimum(begin[at][:, None] + np.arange(w), len(data) - 1)
            symbols = self.inner[data[where]]
            symbols[np.arange(len(at)), k - 1] = self.last[data[begin[at] + k - 1]]
            ids, got = self._merge(symbols, k)
            counts[owner[at]] = got
            found.append(ids)
            keys.append(np.repeat(owner[at], got))
        hard = np.flatnonzero(~easy)
        if len(hard):
            for i, e in zip(hard, self.lib.encode_batch(words.take(pa.array(hard)).to_pylist(), add_special_tokens=False)):
                counts[2 * i] = len(e.ids)
                found.append(np.array(e.ids, np.int32))
                keys.append(np.full(len(e.ids), 2 * i))
        if not found:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        by = np.argsort(np.concatenate(keys), kind="stable")
        return np.concatenate(found)[by], counts.reshape(n, 2).sum(axis=1)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        ids, count = self._words(coded.dictionary)
        word = coded.indices.to_numpy()
        start = np.cumsum(count) - count
        held = count[word]
        ends = np.cumsum(held)
        where = np.repeat(start[word] - (ends - held), held)
        where += np.arange(len(where))
        bounds = np.r_[0, ends][split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids[where], np.diff(bounds)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        ids, count = self.flat(texts)
        return np.split(ids, np.cumsum(count)[:-1])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def steps(texts: pa.Array):
    """Slices of a string column of at most about STEP_BYTES; a longer text stands alone."""
    size = pc.binary_length(texts).fill_null(0).to_numpy()
    first = total = 0
    for i, n in enumerate(size):
        if i > first and total + n > STEP_BYTES:
            yield first, i
            first, total = i, 0
        total += int(n)
    if first < len(texts):
        yield first, len(texts)
