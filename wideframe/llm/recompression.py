"""Repeated passages by recompression: rounds that name runs and pairs, so that equal word sequences get equal symbols.

A symbol's name is a hash of the names it was made of. That makes names global without a dictionary: two tasks that meet
the same run or pair give it the same name. Every symbol carries its context, the words that must be seen to know that the
rounds make this symbol here and nowhere differently. A window that holds a symbol's whole context therefore finds the
same symbol in every document that holds the window, whatever stands around it.
"""

from __future__ import annotations

import numpy as np

from .words import BASES, Words, gram_hashes, gram_starts, mixed, powers

ROUNDS = 2
#: Contexts longer than this many words are not used: the window would find few symbols of its own.
REACH = 9
#: Symbols whose context has this many letters are preferred; shorter ones are often common phrases.
LETTERS = 16
_RUN, _PAIR = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Symbols:
    """One text level: names, the words ``[low, high)`` of each context, and the text that each belongs to."""

    def __init__(self, name, low, high, owner):
        self.name, self.low, self.high, self.owner = name, low, high, owner

    def _neighbours(self):
        """Context ends of the symbols before and after; outside a text nothing can be known."""
        far = np.int64(1) << np.int64(40)
        same = self.owner[1:] == self.owner[:-1]
        before = np.full(len(self.name), -far)
        after = np.full(len(self.name), far)
        before[1:][same] = self.low[:-1][same]
        after[:-1][same] = self.high[1:][same]
        return before, after

    def runs(self) -> Symbols:
        """Each maximal run of one symbol becomes a symbol; both neighbours must be seen to know its length."""
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.owner[1:] != self.owner[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(self.name))
        length = (end - begin).astype(np.uint64)
        before, after = self._neighbours()
        name = np.where(length > 1, mixed(self.name[begin] * _RUN + length), self.name[begin])
        return Symbols(name, before[begin], after[end - 1], self.owner[begin])

    def pairs(self, round_: int) -> Symbols:
        """A symbol of the left half of the alphabet and one of the right half behind it become one symbol."""
        n = len(self.name)
        seed = np.array([round_], np.uint64) * _PAIR
        right = ((mixed(self.name + seed) >> np.uint64(17)) & np.uint64(1)).astype(bool)
        joins = np.zeros(n, bool)  # with the next one
        joins[:-1] = ~right[:-1] & right[1:] & (self.owner[1:] == self.owner[:-1])
        second = np.zeros(n, bool)
        second[1:] = joins[:-1]
        before, after = self._neighbours()
        low = np.where(right & ~second, before, self.low)
        high = np.where(~right & ~joins, after, self.high)
        begin = np.flatnonzero(~second)
        pair = joins[begin]
        tail = begin + pair
        name = np.where(pair, mixed(self.name[begin] * _PAIR + self.name[tail]), self.name[begin])
        return Symbols(name, low[begin], high[tail], self.owner[begin])


def window_symbols(words: Words, hashes: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text and fingerprint of every window.

    The fingerprint is the hash of the context of one symbol that the window holds: of the symbols of the highest round with
    a context inside the window, the one whose hash is largest. A window that holds none is its own fingerprint. It depends
    on the window's words alone.
    """
    starts, owner = gram_starts(words.first, window)
    if not len(starts):
        return starts, owner, np.zeros(0, np.uint64)
    n = len(hashes)
    base, back = powers(BASES[1], n + 1), powers(np.uint64(pow(int(BASES[1]), -1, 1 << 64)), n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * base[:n], dtype=np.uint64)])
    letters = np.concatenate([np.zeros(1, np.int64), np.cumsum(words.ends - words.starts)])
    level = Symbols(hashes, np.arange(n), np.arange(n) + 1, np.repeat(np.arange(len(words.first) - 1), np.diff(words.first)))
    best = np.zeros(n, np.uint64)
    for round_ in range(1, rounds + 1):
        level = level.runs().pairs(round_)
        size = level.high - level.low
        use = np.flatnonzero((size <= min(REACH, window)) & (size > 0))[::-1]  # of symbols that begin alike the first, the shortest, stays
        low, high = level.low[use], level.high[use]
        key = mixed(((total[high] - total[low]) * back[low]) ^ size[use].astype(np.uint64)) >> np.uint64(8)
        rank = np.where(letters[high] - letters[low] >= LETTERS, round_ + rounds, round_).astype(np.uint64)
        at_key, at_size = np.zeros(n + window, np.uint64), np.full(n + window, window + 1, np.int8)
        at_key[low] = key | (rank << np.uint64(56))
        at_size[low] = size[use]
        for k in range(window - 1):
            np.maximum(best, np.where(at_size[k:k + n] <= window - k, at_key[k:k + n], np.uint64(0)), out=best)
    chosen = best[starts]
    alone = np.flatnonzero(chosen == 0)
    if len(alone):
        chosen[alone] = gram_hashes(hashes, window)[starts[alone]] >> np.uint64(8)
    return starts, owner, chosen
