"""Pre-tokenisation of many texts at once, without a regular expression engine.

The split pattern of the public byte-level vocabularies (contractions, runs of
letters, of numbers, of other characters with one optional leading space, and
runs of white space) is compiled into an automaton over codepoint classes.
One look-ahead character is folded into the class, so the automaton is a plain
finite-state machine.  Its transition functions generate a small monoid; every
character becomes a monoid element, and a blocked associative scan over the
monoid's multiplication table gives the state before every character, hence
the token starts.  Everything is array arithmetic; texts in a batch are
separated by an element that resets the machine.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# classes of characters, with the look-ahead folded in
LETTER, NUMBER, OTHER, SPACE_INNER, SPACE_JOINS, SPACE_ALONE, APOS_ONE, APOS_TWO, RESET = range(9)
# states of the machine: which kind of token is open
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, PREFIX, ONE_MORE, TWO_MORE = range(8)

#: White_Space of Unicode, the meaning of \s in the pattern (fixed values).
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Characters handled per scan: bounds the memory of the work arrays.
SCAN_CHARS = 1 << 20


@lru_cache(maxsize=1)
def codepoint_classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for every codepoint."""
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            table[cp] = LETTER
        elif major == "N":
            table[cp] = NUMBER
    table[list(WHITE)] = 3
    return table


def _step(kind: int, state: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at a character of this class."""
    if kind == RESET:
        return START, False
    if kind == LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return START, False
        return IN_LETTERS, state not in (IN_LETTERS, PREFIX)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, PREFIX)
    if kind == SPACE_INNER:
        return IN_SPACE, state != IN_SPACE
    if kind == SPACE_JOINS:
        return PREFIX, True
    if kind == SPACE_ALONE:
        return START, True
    if state in (IN_OTHER, PREFIX):
        return IN_OTHER, False
    return {OTHER: IN_OTHER, APOS_ONE: ONE_MORE, APOS_TWO: TWO_MORE}[kind], True


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, multiplication table, image of START under each element, starts[class, state])."""
    gens = [tuple(_step(k, s)[0] for s in range(8)) for k in range(9)]
    index = {tuple(range(8)): 0}
    order = list(index)
    for f in order:
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in index:
                index[h] = len(order)
                order.append(h)
    times = np.array([[index[tuple(g[x] for x in f)] for g in order] for f in order], np.uint8 if len(order) < 256 else np.uint16)
    of_class = np.array([index[g] for g in gens], times.dtype)
    image = np.array([f[START] for f in order], np.uint8)
    starts = np.array([[_step(k, s)[1] for s in range(8)] for k in range(9)], bool)
    return of_class, times, image, starts


def exclusive_scan(elements: np.ndarray, times: np.ndarray, block: int = 128) -> np.ndarray:
    """Product of all earlier elements, for each position; products are associative, so blocks are scanned side by side and their totals by the same scan."""
    n, width = len(elements), times.shape[0]
    flat = times.ravel()
    if n <= block:
        out, acc = np.empty(n, elements.dtype), 0
        for i, e in enumerate(elements.tolist()):
            out[i] = acc
            acc = int(flat[acc * width + e])
        return out
    rows = -(-n // block)
    padded = np.zeros(rows * block, elements.dtype)
    padded[:n] = elements
    by_step = np.ascontiguousarray(padded.reshape(rows, block).T)
    inner = np.empty_like(by_step)
    acc = np.zeros(rows, np.intp)
    for i in range(block):
        inner[i] = acc
        acc = flat[acc * width + by_step[i]].astype(np.intp)
    carry = exclusive_scan(acc.astype(elements.dtype), times, block).astype(np.intp)
    return flat[(carry * width)[None, :] + inner].T.ravel()[:n]


class Scan:
    """Slices of a batch of texts: `data` holds UTF-8 bytes, slice i is data[start[i]:end[i]] and belongs to text doc[i]."""

    __slots__ = ("data", "doc", "end", "start")

    def __init__(self, texts: list[str]):
        joined = "\0".join(texts)
        raw = joined.encode("utf-8")
        self.data = np.frombuffer(raw, np.uint8)
        cps = self.data if len(raw) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(cps)
        if not n:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            return
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        firsts = np.zeros(len(texts), np.int64)
        np.cumsum(chars[:-1] + 1, out=firsts[1:])
        seps = firsts[1:] - 1
        kind = codepoint_classes()[cps]
        kind[seps] = RESET
        white = kind == 3
        stops = np.ones(n, bool)  # the next character is white or there is none
        stops[:-1] = white[1:] | (kind[1:] == RESET)
        last = white & ~stops
        space = cps == 0x20
        kind[last & space] = SPACE_JOINS
        kind[last & ~space] = SPACE_ALONE
        at = np.flatnonzero(cps == 0x27)
        if len(at):
            at = at[kind[at] != RESET]
            padded = np.zeros(n + 2, np.uint32)
            padded[:n] = cps
            padded[seps] = 0
            one, two = padded[at + 1], padded[at + 2]
            is_one = np.isin(one, [ord(c) for c in "stmd"])
            is_two = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
            kind[at[is_one]] = APOS_ONE
            kind[at[is_two]] = APOS_TWO
        of_class, times, image, starts = monoid()
        state = image[exclusive_scan(of_class[kind], times)]
        begin = np.flatnonzero(starts[kind, state])
        stop = np.append(begin[1:], n)
        doc = np.searchsorted(firsts, begin, side="right") - 1
        lasts = np.flatnonzero(doc[:-1] != doc[1:]) if len(doc) else doc
        stop[lasts] = (firsts + chars)[doc[lasts]]
        if len(doc):
            stop[-1] = (firsts + chars)[doc[-1]]
        if cps is self.data:
            self.start, self.end = begin, stop
        else:
            at = np.zeros(n + 1, np.int64)
            np.cumsum(1 + (cps > 0x7F).astype(np.int8) + (cps > 0x7FF) + (cps > 0xFFFF), out=at[1:])
            self.start, self.end = at[begin], at[stop]
        self.doc = doc


def groups(texts: list[str], most: int = SCAN_CHARS):
    """(first, last) ranges of texts that hold about `most` characters each; a longer text is a range of its own."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
