"""Public byte-level vocabularies as merge tables; files are read where `public_tokenizers.path` says and never copied."""

from __future__ import annotations

import base64
import json
from functools import lru_cache


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


class Vocab:
    """tokens[id] bytes; pair[(left, right)] = id made by merging; lower ids merge first."""

    def __init__(self, tokens: dict[int, bytes], pair: dict[tuple[int, int], int], special: dict[str, int]):
        self.tokens, self.pair, self.special = tokens, pair, special
        self.id_of = {v: k for k, v in tokens.items()}
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.size = max([*tokens, *special.values()]) + 1

    def merge(self, word: bytes) -> list[int]:
        """Pair merging: the pair with the lowest rank first, leftmost among equals."""
        ids, pair = [self.byte_id[b] for b in word], self.pair
        if len(ids) > 200:
            return self._merge_long(ids)
        none, get = self.size, pair.get
        ranks = [get(x, none) for x in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((best, ids[k + 1]), none)
            if k:
                ranks[k - 1] = get((ids[k - 1], best), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for very long words."""
        import heapq

        n, pair = len(ids), self.pair
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := pair.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if not alive[k] or nxt >= n or ids[k] != a or ids[nxt] != b:
                continue
            ids[k], alive[nxt], after[k] = r, False, after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if (x := pair.get((r, ids[after[k]]))) is not None:
                    heapq.heappush(heap, (x, k, r, ids[after[k]]))
            if before[k] >= 0 and (x := pair.get((ids[before[k]], r))) is not None:
                heapq.heappush(heap, (x, before[k], ids[before[k]], r))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]


@lru_cache(maxsize=4)
def load(name: str) -> Vocab:
    """A .json vocabulary lists its merges; in a .tiktoken one any two tokens whose bytes together are a token merge into it."""
    if name.endswith(".json"):
        with open(_file(name), encoding="utf-8") as f:
            spec = json.load(f)
        table = _bytes_of_chars()
        raw = {k: bytes(table[c] for c in k) for k in spec["model"]["vocab"] if all(c in table for c in k)}
        ids = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = {ids[k]: v for k, v in raw.items() if k not in special}
        pair = {}
        for m in spec["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            pair[ids[a], ids[b]] = ids[a + b]
        if list(pair.values()) != sorted(pair.values()):
            raise ValueError(f"{name}: ids do not follow the order of merges")
        return Vocab(tokens, pair, special)
    with open(_file(name), "rb") as f:
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    id_of = {v: k for k, v in tokens.items()}
    pair = {}
    for k, t in tokens.items():
        for cut in range(1, len(t)):
            a, b = id_of.get(t[:cut]), id_of.get(t[cut:])
            if a is not None and b is not None:
                pair[a, b] = k
    return Vocab(tokens, pair, {})
