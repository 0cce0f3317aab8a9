"""A run-length index of a set of strings, and matching statistics against it.

The suffixes of all strings are put in order; the character before each suffix, in that order, is
the Burrows-Wheeler transform. Repetitive strings make long runs in it, so it is kept as
runs, each with its symbol, its start, the number of equal symbols before it and the text positions
of its first and last suffix (the sampled run ends). Strings carry a tag: symbols of another
tag are other symbols, so one index answers for many separate sets at once.

Patterns are streamed from right to left, all of them in step. While a pattern's next character is
that of its row's run, the row moves by the last-to-first mapping and the match grows by one.
Where it is not, the nearest runs of that character above and below offer their sampled
ends; the one with the longer common extension is where the longest match continues.
"""

from __future__ import annotations

import numpy as np

_CODES = 257


def flat(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All strings in one array, and their lengths."""
    return np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64)


def _within(lengths: np.ndarray) -> np.ndarray:
    """Place of each character within its string."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and the rank of each among the distinct ones."""
    order = np.argsort(key)
    ranked = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    return order, rank


class RunIndex:
    """Index of the strings ``data`` of the given ``lengths`` and ``tags``, for matches up to ``depth``."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, tags: np.ndarray, depth: int = 64):
        ends = lengths + 1  # each string and its end mark
        n = int(ends.sum())
        place = _within(ends)
        mark = place == np.repeat(lengths, ends)
        self.chars = np.full(n, -1, np.int16)
        self.chars[~mark] = data
        codes = np.repeat(tags, ends) * _CODES + self.chars + 1
        order = self._order(codes, np.repeat(tags, ends), np.repeat(ends, ends) - place, depth)
        before = np.where(place[order] == 0, -1, codes[order - 1])
        starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if n else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [n]]))
        self.n, self.starts, self.symbols = n, starts, before[starts]
        by_symbol = np.lexsort((starts, self.symbols))
        self.where = np.empty(len(starts), np.int64)
        self.where[by_symbol] = np.arange(len(starts))
        self.sorted_symbols = self.symbols[by_symbol]
        self.sorted_keys = self.sorted_symbols * (n + 1) + starts[by_symbol]
        self.sorted_sizes = sizes[by_symbol]
        total = np.cumsum(self.sorted_sizes) - self.sorted_sizes
        first = np.searchsorted(self.sorted_symbols, self.sorted_symbols)
        #: Row to which the first row of each run is mapped.
        self.target = np.searchsorted(codes[order], self.sorted_symbols) + total - total[first] if n else total
        self.heads = order[starts][by_symbol]
        self.tails = order[starts + sizes - 1][by_symbol]

    @staticmethod
    def _order(codes: np.ndarray, tags: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
        """Order of all suffixes by tag and their first ``depth`` characters: doubling of ranked prefixes.

        ``left`` is the number of symbols up to the end mark, itself included. Suffixes that agree so far
        follow each other in any order: a match is never followed further than that.
        """
        n, width = len(codes), 6
        if not n:
            return np.zeros(0, np.int64)
        own = np.concatenate([codes - tags * _CODES, np.zeros(width, np.int64)])  # 0 is the end mark
        key = np.zeros(n, np.int64)
        for k in range(width):
            key = key * 512 + np.where(left > k, own[k : n + k], 0)
        rank = _ranked(key)[1]
        while True:
            beyond = np.where(left > width, rank[np.minimum(np.arange(n) + width, n - 1)] + 1, 0)
            if width == 6:  # the tag comes first of all
                rank = _ranked(tags * (n + 1) + rank)[1]
            order, rank = _ranked(rank * (n + 1) + beyond)
            width *= 2
            if width >= depth or rank[order[-1]] == n - 1:
                return order

    def _extension(self, rows: np.ndarray, text: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common length of indexed text from ``rows`` and pattern text from ``at``, up to ``most``, which
        the present match has: pairs that agree on eight characters go on to the next eight."""
        common = np.zeros(len(rows), np.int64)
        going, done = np.flatnonzero(most > 0), 0
        steps = np.arange(8)
        while len(going):
            a = self.chars[np.minimum(rows[going][:, None] + (steps + done), self.n - 1)]
            same = a == text[at[going][:, None] + np.minimum(steps + done, most[going][:, None])]
            n = np.where(same.all(axis=1), 8, same.argmin(axis=1))
            done += 8
            common[going] += n
            going = going[(n == 8) & (common[going] < most[going])]
        return np.minimum(common, most)

    def reaches(self, data: np.ndarray, lengths: np.ndarray, tags: np.ndarray, length: int) -> np.ndarray:
        """For each character of the patterns, whether the match that begins there has ``length`` characters at least,
        which must not be more than the index's depth."""
        out = np.zeros(len(data), bool)
        if not self.n or not len(data):
            return out
        # patterns apart, with room behind each, so that comparisons end at its end
        text = np.full(int((lengths + length).sum()), -2, np.int16)
        base = np.cumsum(lengths + length) - (lengths + length)
        text[np.repeat(base, lengths) + _within(lengths)] = data
        origin = np.cumsum(lengths) - lengths
        who = np.flatnonzero(lengths >= length)
        row, match, last = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64), len(self.sorted_keys) - 1
        step = 0
        while len(who):
            left = lengths[who] - 1 - step
            at = base[who] + left
            symbol = tags[who] * _CODES + text[at] + 1
            run = np.searchsorted(self.starts, row, side="right") - 1
            go = self.where[run]
            moved, grown = self.target[go] + row - self.starts[run], match + 1
            jump = np.flatnonzero(self.symbols[run] != symbol)
            if len(jump):
                wanted = symbol[jump]
                below = np.searchsorted(self.sorted_keys, wanted * (self.n + 1) + row[jump])
                above = np.maximum(below - 1, 0)
                below = np.minimum(below, last)
                common = np.full((2, len(jump)), -1, np.int64)
                for side, (run_there, samples) in enumerate(((above, self.tails), (below, self.heads))):
                    has = np.flatnonzero(self.sorted_symbols[run_there] == wanted)
                    if len(has):
                        common[side, has] = self._extension(samples[run_there[has]], text, at[jump[has]] + 1, np.minimum(match[jump[has]], length - 1))
                down = common[1] > common[0]
                moved[jump] = np.where(down, self.target[below], self.target[above] + self.sorted_sizes[above] - 1)
                grown[jump] = common.max(axis=0) + 1
                moved[jump[grown[jump] == 0]] = 0
            row, match = moved, grown
            reached = match >= length
            out[origin[who[reached]] + left[reached]] = True
            # a pattern ends where what is left of it is too short for a match
            alive = (left > 0) & (match + left >= length)
            if not alive.all():
                who, row, match = who[alive], row[alive], match[alive]
            step += 1
        return out
