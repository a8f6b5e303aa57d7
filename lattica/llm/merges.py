"""A byte-pair vocabulary compiled to a deterministic transducer over a word's bytes.

Two adjacent tokens of an encoding are *fitting*: merging their joint text gives back just the two.
A sequence of tokens is a word's encoding exactly if all neighbours fit, so the encoding of every
prefix has one last token: the one that ends there and fits the last token of what is before it.
A state therefore need only hold, for every place from which a token of the vocabulary may still be
growing, the trie node reached, the last token before that place, and the tokens counted there
relative to now.  A transition reads one byte (the word's last byte is a symbol of its own) and is
annotated with the change of the token count and the last token it ends; states and transitions
are compiled when first reached, and the machine starts anew when it has too many.
"""

from __future__ import annotations

import json
import math
from array import array

import numpy as np

from lattica.llm.pair_table import PairTable

#: Added to a byte that ends a word; symbols are below 2**SHIFT.
LAST, SHIFT = 256, 9


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeMachine:
    """Counts and ids of words by transitions compiled from a vocabulary and its merges alone."""

    LONG = 512

    def __init__(self, vocab: dict[str, int], merges: list, end: str = "</w>", max_states: int = 120_000) -> None:
        of_char, self.max_states = byte_alphabet(), max_states
        self.child: dict[int, int] = {}
        self.token: dict[int, int] = {}
        self.symbols: dict[int, tuple[int, ...]] = {}
        nodes = 1
        for text, i in vocab.items():
            final = text.endswith(end) and text != end
            codes = [of_char[c] for c in (text.removesuffix(end) if final else text)]
            if final:
                codes[-1] += LAST
            at = 0
            for s in codes:
                key = at << SHIFT | s
                if key not in self.child:
                    self.child[key] = nodes
                    nodes += 1
                at = self.child[key]
            self.token[at], self.symbols[i] = i, tuple(codes)
        self.unit = {codes[0]: i for i, codes in self.symbols.items() if len(codes) == 1}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.inner = {key >> SHIFT for key in self.child}
        self.length = np.zeros(max(self.symbols) + 1, np.int64)
        self.length[list(self.symbols)] = [len(codes) for codes in self.symbols.values()]
        self.edge: dict[int, tuple[list, list] | None] = {}
        self._reset()

    def _reset(self) -> None:
        # A state is kept as the bytes of its (node, last token, relative count) triples, which are smaller than tuples.
        self.number: dict[bytes, int] = {array("i", (0, -1, 0)).tobytes(): 0}
        self.states: list[bytes] = list(self.number)
        self.table = PairTable()
        self.moves = np.zeros((1 << 10, 3), np.int32)  # next state, change of the count, last token
        self.n_moves = 0
        self.rows: dict[int, list[int]] = {}
        self.fits: dict[int, bool] = {}

    def merge(self, ids: list[int], seen: list | None = None) -> list[int]:
        """The merges applied as they are defined: the lowest rank first, the leftmost of equals; `seen` gets (rank, place, length)."""
        while len(ids) > 1:
            ranked = [(self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
            if not ranked:
                break
            r, k = min(ranked)
            if seen is not None:
                seen.append((r, k, len(ids)))
            ids = [*ids[:k], self.rank[ids[k], ids[k + 1]][1], *ids[k + 2 :]]
        return ids

    def edges(self, token: int) -> tuple[list, list] | None:
        """What stands first and last while a token's text is merged, each with the rank that ends it; None if the text gives other tokens."""
        if token not in self.edge:
            ids, seen = [self.unit[s] for s in self.symbols[token]], []
            first, last = [], []
            if self.merge(ids, seen) == [token]:
                for r, k, n in seen:
                    if k == 0:
                        first.append((ids[0], r))
                    if k + 2 == n:
                        last.append((ids[-1], r))
                    ids = [*ids[:k], self.rank[ids[k], ids[k + 1]][1], *ids[k + 2 :]]
                self.edge[token] = [*first, (token, math.inf)], [*last, (token, math.inf)]
            else:
                self.edge[token] = None
        return self.edge[token]

    def fitting(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: the start) in an encoding."""
        key = a << 20 | b
        if (known := self.fits.get(key)) is None:
            known = self.fits[key] = self._fitting(a, b)
        return known

    def _fitting(self, a: int, b: int) -> bool:
        """At no time while both are merged is a merge across them the next one."""
        right = self.edges(b)
        if right is None or a < 0:
            return right is not None
        ends, starts = self.edges(a)[1], right[0]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = ends[i], starts[j]
            across = self.rank.get((x, y), (math.inf,))[0]
            if across < x_until and across <= y_until and across < math.inf:
                return False
            if x_until <= y_until:
                if x_until == math.inf:
                    return True
                i += 1
            else:
                j += 1

    def _move(self, state: int, symbol: int) -> int:
        """Compile one transition; its row in `moves`."""
        child, inner = self.child.get, self.inner
        held = iter(array("i", self.states[state]))
        grown = [(n, last, rel) for node, last, rel in zip(held, held, held) if (n := child(node << SHIFT | symbol)) is not None]
        for n, last, rel in grown:
            token = self.token.get(n)
            if token is not None and self.fitting(last, token):
                delta = rel + 1
                break
        after = array("i", [x for n, last, rel in grown if n in inner for x in (n, last, rel - delta)] + [0, token, 0]).tobytes()
        to = self.number.setdefault(after, len(self.states))
        if to == len(self.states):
            self.states.append(after)
        if self.n_moves == len(self.moves):
            self.moves = np.concatenate([self.moves, np.zeros_like(self.moves)])
        self.moves[self.n_moves] = to, delta, token
        self.n_moves += 1
        return self.n_moves - 1

    def _steps(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Rows of `moves` for pairs of state and symbol; missing ones are compiled."""
        block = symbol.astype(np.uint64)
        row = self.table.find(state, block)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            keys, back = np.unique(state[miss] << SHIFT | symbol[miss], return_inverse=True)
            new = np.array([self._move(k >> SHIFT, k & (1 << SHIFT) - 1) for k in keys.tolist()], np.int32)
            self.table.add(keys >> SHIFT, (keys & (1 << SHIFT) - 1).astype(np.uint64), new)
            row[miss] = new[back]
        return row

    def words(self, raws: list[bytes], part: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of non-empty words, and all their ids in order: words step through the machine together, byte by byte."""
        counts, ids = [], []
        for lo in range(0, len(raws), part):
            if len(self.states) > self.max_states:
                self._reset()
            c, i = self._words(raws[lo : lo + part])
            counts.append(c)
            ids.append(i)
        return np.concatenate(counts or [np.zeros(0, np.int64)]), np.concatenate(ids or [np.zeros(0, np.int32)])

    def _alone(self, symbol: np.ndarray, ends: np.ndarray, start: int, n: int) -> int:
        """One long word, step by step; returns its count and fills in the tokens that end."""
        state, count, rows = 0, 0, self.rows
        for at in range(start, start + n):
            key = state << SHIFT | int(symbol[at])
            if key not in rows:
                rows[key] = self.moves[self._steps(np.array([state]), symbol[at : at + 1])[0]].tolist()
            state, delta, ends[at] = rows[key]
            count += delta
        return count

    def _words(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        start = np.cumsum(size) - size
        symbol = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        symbol[start + size - 1] += LAST
        ends = np.empty(len(symbol), np.int32)
        counts = np.zeros(len(raws), np.int64)
        for i in np.flatnonzero(size > self.LONG).tolist():
            counts[i] = self._alone(symbol, ends, int(start[i]), int(size[i]))
        live, k = np.flatnonzero(size <= self.LONG), 0
        state = np.zeros(len(live), np.int64)
        while len(live):
            at = start[live] + k
            row = self._steps(state, symbol[at])
            to, delta, token = self.moves[row].T
            counts[live] += delta
            ends[at] = token
            k += 1
            go = size[live] > k
            live, state = live[go], to[go].astype(np.int64)
        # Tokens are read off backwards: the last one ends with the word, the one before where it starts.
        out = np.empty(int(counts.sum()), np.int32)
        place, left, live = np.cumsum(counts), size.copy(), np.arange(len(raws))
        while len(live):
            token = ends[start[live] + left[live] - 1]
            place[live] -= 1
            out[place[live]] = token
            left[live] -= self.length[token]
            live = live[left[live] > 0]
        return counts, out


def load(path: str) -> tuple[MergeMachine, dict[str, int]]:
    """The machine of a tokenizer file and its special strings with their ids."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    special = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
    return MergeMachine(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "</w>"), special
