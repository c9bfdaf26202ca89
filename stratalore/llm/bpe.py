"""Rank-synchronous byte-pair merging over ragged numpy arrays.

A batch of pre-tokens is one flat array of symbol ids and an array saying which
pre-token each symbol belongs to. In each round every pre-token applies its own
lowest-ranked pair at all places at once; pre-tokens without a mergeable pair
leave the batch. Merging all occurrences of the lowest pair together equals
merging them one by one from the left because every merge makes a string that no
earlier merge makes, so no round can create a pair of lower rank. The constructor
checks that property of the vocabulary.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

#: Rank of a pair that never merges.
NEVER = np.int32(2**31 - 1)
#: ASCII and Latin letters that normalisation leaves alone but for their case.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(f"([{_LETTERS}]+)([!-/:-@\\[-`{{-~]*)")


class RankMerger:
    """Counts tokens of words as a ``tokenizers`` BPE file defines them."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        model = parsed["model"]
        vocab, merges, end = model["vocab"], model["merges"], model["end_of_word_suffix"] or ""
        self.library = Tokenizer.from_str(spec)
        special = [t["content"] for t in parsed["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_set = frozenset(special)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(pairs):
            if a + b in made or made.get(a, -1) >= rank or made.get(b, -1) >= rank:
                raise ValueError("a merge rebuilds an earlier string; simultaneous merging would not be exact")
            made[a + b] = rank
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << np.uint64(32) | right
        # Open-addressed pair table; an empty slot ends a search.
        self.bits = max(8, int(np.ceil(np.log2(len(keys) * 8))))
        size = 1 << self.bits
        slots = np.full(size, np.uint64(2**64 - 1))
        ranks = np.full(size, NEVER, np.int32)
        for rank, key in enumerate(keys.tolist()):
            at = self._slot(key)
            while ranks[at] != NEVER:
                at = (at + 1) % size
            slots[at], ranks[at] = key, rank
        self.slots, self.ranks = slots, ranks
        letters = _byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + end] for c in letters], np.int32)

    _MULT = 0x9E3779B97F4A7C15

    def _slot(self, key: int) -> int:
        return ((key * self._MULT) & (2**64 - 1)) >> (64 - self.bits)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = ((key * np.uint64(self._MULT)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.ranks[at]
        wrong = np.flatnonzero((self.slots[at] != key) & (out != NEVER))
        mask = (1 << self.bits) - 1
        while len(wrong):  # another pair's slot: go on to the next one
            at[wrong] = (at[wrong] + 1) & mask
            out[wrong] = self.ranks[at[wrong]]
            wrong = wrong[(self.slots[at[wrong]] != key[wrong]) & (out[wrong] != NEVER)]
        return out

    def count(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Surviving symbols of each pre-token; ``flat`` holds their bytes (uint8), none empty."""
        counts = np.zeros(len(lengths), np.int64)
        for done, sizes, _ in self._finished(flat, lengths):
            counts[done] = sizes
        return counts

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols of all pre-tokens, one after the other, and the number of each one's."""
        groups = list(self._finished(flat, lengths))
        counts = np.zeros(len(lengths), np.int64)
        for done, sizes, _ in groups:
            counts[done] = sizes
        starts, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.uint32)
        for done, sizes, symbols in groups:
            out[np.repeat(starts[done] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(symbols))] = symbols
        return out, counts

    def _finished(self, flat: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pre-tokens without a pair that merges, as they turn up: their numbers, sizes and symbols."""
        ids, sizes = np.arange(len(lengths)), lengths.astype(np.int64)
        last = np.cumsum(sizes) - 1
        sym = self.inner[flat]
        sym[last] = self.final[flat[last]]
        ranks = np.full(len(sym), NEVER, np.int32)
        if len(sym) > 1:
            ranks[:-1] = self.pair_ranks(sym[:-1], sym[1:])
        ranks[last] = NEVER
        while len(sizes):
            best = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            done = best == NEVER
            if done.any():
                left = ~done
                keep = np.repeat(left, sizes)
                yield ids[done], sizes[done], sym[~keep]
                sym, ranks = sym[keep], ranks[keep]
                ids, sizes, best = ids[left], sizes[left], best[left]
                if not len(sizes):
                    break
            hit = ranks == np.repeat(best, sizes)
            if (hit[1:] & hit[:-1]).any():
                # In a run such as "aaa" pairs overlap; from the left, every second one merges.
                index = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], index, -1))
                hit &= (index - run) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.merged[ranks[at]]
            # Positions of the merged symbols once their right halves are gone.
            moved = at - np.arange(len(at))
            ends = np.cumsum(sizes) - 1
            sizes = sizes - np.add.reduceat(hit, np.r_[0, ends[:-1] + 1])
            alive = np.ones(len(sym), bool)
            alive[at + 1] = False
            was_end = np.zeros(len(sym), bool)
            was_end[ends] = True
            closes = was_end[at + 1]  # the right half closed its pre-token
            sym, ranks = sym[alive], ranks[alive]
            self._renew(sym, ranks, moved[~closes])
            ranks[moved[closes]] = NEVER
            before = moved[moved > 0] - 1
            open_before = np.ones(len(sym), bool)
            open_before[np.cumsum(sizes) - 1] = False
            self._renew(sym, ranks, before[open_before[before]])

    def _renew(self, sym: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> None:
        ranks[at] = self.pair_ranks(sym[at], sym[at + 1])

    def pre_tokens(self, word: bytes) -> tuple[int, list[bytes]]:
        """Special tokens in a word without white space, and the bytes of its pre-tokens."""
        text = word.decode("utf-8", "replace")
        if m := _PLAIN.fullmatch(text):
            return 0, [x.encode() for x in (m[1].lower(), m[2]) if x]
        specials, parts = 0, []
        for piece in self.special.split(text) if self.special else [text]:
            if piece in self.special_set:
                specials += 1
            elif piece:
                normal = self.library.normalizer.normalize_str(piece)
                parts += [bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.library.pre_tokenizer.pre_tokenize_str(normal) if x]
        return specials, parts

    def count_words(self, words: list[bytes]) -> list[int]:
        """Tokens of each word; a word has no ASCII white space in it."""
        totals = np.zeros(len(words), np.int64)
        owner: list[int] = []
        parts: list[bytes] = []
        for i, word in enumerate(words):
            specials, found = self.pre_tokens(word)
            totals[i] = specials
            parts += found
            owner += [i] * len(found)
        if parts:
            place = {p: k for k, p in enumerate(dict.fromkeys(parts))}
            lengths = np.fromiter(map(len, place), np.int64, len(place))
            got = self.count(np.frombuffer(b"".join(place), np.uint8), lengths)
            each = got[np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))]
            totals += np.bincount(np.array(owner), each, len(words)).astype(np.int64)
        return totals.tolist()


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out
