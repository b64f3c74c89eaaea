"""Byte-pair encoding as a deterministic transducer, compiled on demand.

Reading a word byte by byte, the machine's state is the set of places where a
token may still be open: for each, the trie node of the bytes read since, the
last token of the encoding that ends there and that encoding's length relative
to the current one.  A prefix's encoding is unique, and it extends an earlier
prefix's encoding by one token exactly if the pair of tokens is stable (their
own bytes encode to just these two), so the next state follows from the state
and the byte alone.  Each transition is annotated with the change in the count
of emitted tokens and with the token that then comes last.

States are made when first reached and kept in one hash table of transitions
per process; when that is full it starts anew, so memory is bounded.

A long slice is cut into chunks that are read side by side.  Each gives a piece of
its state map, from a state it may begin in (what the bytes just before it lead
to) to the state it ends in and the tokens emitted.  Maps of neighbouring chunks
compose, in a tree of pairs; where a composition asks for a state that the right
map lacks, that side is read from this state, so the count is exact.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

from .textscan import Scan
from .vocab import Vocab, load

#: Transitions kept per process, in a table of twice as many slots.
MOST = 1 << 19
SHIFT = np.uint64(64 - 20)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 20) - 1
#: Bytes of a chunk of a long slice, of what is read before it to find a state, and of a slice that is not cut.
CHUNK, BEFORE, SHORT = 2048, 256, 8192


class Transducer:
    def __init__(self, vocab: Vocab):
        self.vocab = vocab
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for k, t in vocab.tokens.items():
            at = 0
            for b in t:
                if b not in self.child[at]:
                    self.child[at][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                at = self.child[at][b]
            self.token[at] = k
        self.split = {made: ab for ab, made in sorted(vocab.pair.items(), key=lambda x: -x[1])}
        self._stable: dict[int, bool] = {}
        self._spine: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.reset()

    def reset(self) -> None:
        first = array("q", [0, -1, 0]).tobytes()
        self.states = [first]
        self.index = {first: 0}
        self.made = 0
        self.key = np.full(MASK + 1, -1, np.int64)  # state << 8 | byte
        self.to = np.zeros(MASK + 1, np.int32)
        self.delta = np.zeros(MASK + 1, np.int16)

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank of the merge that ends it) down the left (0) or right (1) edge of a token's merge tree."""
        key = (token, side)
        if key not in self._spine:
            out, ends = [], 1 << 40
            while True:
                out.append((token, ends))
                if token not in self.split:
                    break
                ends, token = token, self.split[token][side]
            self._spine[key] = out
        return self._spine[key]

    def stable(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b encode to just a, b: no merge crosses the border while both of its parts stand there."""
        key = a << 20 | b
        got = self._stable.get(key)
        if got is None:
            pair = self.vocab.pair
            got = True
            for x, x_ends in self.spine(a, 1):
                for y, y_ends in self.spine(b, 0):
                    r = pair.get((x, y))
                    # equal ranks merge from the left: x's own merge lies left of the border, y's right of it
                    if r is not None and r < x_ends and r <= y_ends:
                        got = False
                        break
                if not got:
                    break
            if len(self._stable) > 2_000_000:
                self._stable.clear()
            self._stable[key] = got
        return got

    def _make(self, cell: int) -> None:
        state, byte = cell >> 8, cell & 255
        was = array("q", self.states[state])
        open_, made, best = [], -1, 0
        for k in range(0, len(was), 3):
            nxt = self.child[was[k]].get(byte)
            if nxt is None:
                continue
            before, count, tok = was[k + 1], was[k + 2], self.token[nxt]
            if tok >= 0 and made < 0 and (before < 0 or self.stable(before, tok)):
                made, best = tok, count + 1
            if self.child[nxt]:
                open_.append((nxt, before, count))
        now = array("q")
        for node, before, count in open_:
            now.extend((node, before, count - best))
        now.extend((0, made, 0))
        name = now.tobytes()
        to = self.index.setdefault(name, len(self.states))
        if to == len(self.states):
            self.states.append(name)
        slot = ((cell * int(SPREAD)) & 0xFFFFFFFFFFFFFFFF) >> int(SHIFT)
        while self.key[slot] >= 0:
            slot = (slot + 1) & MASK
        self.key[slot], self.to[slot], self.delta[slot] = cell, to, best
        self.made += 1

    def _find(self, cell: np.ndarray) -> np.ndarray:
        """Slots of transitions; an empty slot's number where there is none yet."""
        slot = ((cell.astype(np.uint64) * SPREAD) >> SHIFT).astype(np.int64)
        got = self.key[slot]
        odd = np.flatnonzero((got != cell) & (got >= 0))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & MASK
            got = self.key[slot[odd]]
            odd = odd[(got != cell[odd]) & (got >= 0)]
        return slot

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, begin: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, numbers of the last states) of each slice from its first state (the start state, if none are given), all slices side by side, longest first."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        at, size = start[order], size[order]
        state = np.zeros(len(order), np.int64)
        if begin is not None:
            state[:] = [self._number(begin[k]) for k in order]
        count = np.zeros(len(order), np.int32)
        live = len(order) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1))
        for k, m in enumerate(live.tolist()):
            cell = (state[:m] << 8) + data[at[:m] + k]
            slot = self._find(cell)
            gaps = np.unique(cell[self.key[slot] < 0])
            if len(gaps):
                for c in gaps.tolist():
                    if self.made >= MOST:
                        self.reset()
                        return self.run(data, start, end, begin)
                    self._make(c)
                slot = self._find(cell)
            count[:m] += self.delta[slot]
            state[:m] = self.to[slot]
        counts, states = np.empty(len(order), np.int32), np.empty(len(order), np.int64)
        counts[order], states[order] = count, state
        return counts, states

    def _number(self, name: bytes) -> int:
        k = self.index.setdefault(name, len(self.states))
        if k == len(self.states):
            self.states.append(name)
        return k

    def count(self, scan: Scan) -> np.ndarray:
        """Tokens of each slice of the scan; slices are read in stretches that leave room for all they may add to the table."""
        out, size = np.empty(len(scan.start), np.int32), scan.end - scan.start
        most = min(SHORT, MOST // 8)
        for k in np.flatnonzero(size > most).tolist():
            out[k] = self.long(scan.data, int(scan.start[k]), int(scan.end[k]))
        short = np.flatnonzero(size <= most)
        stretch = np.cumsum(size[short]) // (MOST // 2)
        for part in np.split(short, np.flatnonzero(np.diff(stretch)) + 1) if len(short) else ():
            out[part] = self.run(scan.data, scan.start[part], scan.end[part])[0]
        return out

    def long(self, data: np.ndarray, a: int, b: int, chunk: int = CHUNK) -> int:
        """Tokens of one slice of any length."""
        total, name = 0, self.states[0]
        first = name
        for at in range(a, b, MOST // 4):  # a stretch adds fewer transitions than the table holds
            upto = min(b, at + MOST // 4)
            cuts = np.arange(at, upto, chunk)
            ends = np.minimum(cuts + chunk, upto)
            begin = [self.states[k] for k in self.run(data, np.maximum(cuts - BEFORE, a), cuts, [first] * len(cuts))[1]]
            begin[0] = name
            count, last = self.run(data, cuts, ends, begin)
            maps = [({s: (self.states[t], n)}, x, y) for s, t, n, x, y in zip(begin, last.tolist(), count.tolist(), cuts.tolist(), ends.tolist(), strict=True)]
            while len(maps) > 1:
                maps = [self.compose(data, *maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
            name, n = maps[0][0][name]
            total += n
        return total

    def compose(self, data: np.ndarray, left: tuple, right: tuple) -> tuple[dict[bytes, tuple[bytes, int]], int, int]:
        """The map of two neighbouring stretches (map, first byte, end)."""
        for between, _ in left[0].values():
            if between not in right[0]:
                count, last = self.run(data, np.array([right[1]]), np.array([right[2]]), [between])
                right[0][between] = self.states[int(last[0])], int(count[0])
        return {s: (right[0][t][0], n + right[0][t][1]) for s, (t, n) in left[0].items()}, left[1], right[2]


@lru_cache(maxsize=2)
def transducer(name: str) -> Transducer:
    return Transducer(load(name))
