"""A byte-pair tokenizer compiled to finite-state transducers.

Two deterministic machines run one after the other.

*Lexical machine.*  Over character classes; it finds where each word of the tokenizer's
pre-tokenizer starts.  Its transition monoid (the state maps that class sequences can cause) is
closed once, so the state map of a chunk is a product of small integers; chunk maps compose by a
parallel prefix scan, which gives every chunk its entry state without reading the text in order.

*Word machine.*  The byte-wise machine of `merges` is compiled from the vocabulary and its merges; its
transitions carry the change of the token count.  Before it stands a trie over blocks of eight
characters whose transitions are whole paths of that machine, composed when a word is first seen: the
last one carries how many tokens the word emits and where their ids lie.  Both are kept in flat
arrays, so whole batches of words advance together.

The machines follow the vocabulary with lower case, word ends and white space dropped
(``word_bpe_49k.json``).  Counts and ids equal the library's for every text.  The library itself only
answers for texts that hold a code point which this Python's Unicode tables don't know yet.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np

from lattica.llm.merges import load
from lattica.llm.pair_table import PairTable

# Character classes of the lexical machine.
SPACE, LETTER, NUMBER, OTHER, QUOTE, SINGLE, R, V, L, E = range(10)
N_CLASS = 10
#: A class that no machine reads.
UNKNOWN = 255
# States. QR, QV and QL have read an apostrophe and r, v or l.
BETWEEN, WORD, DIGIT, PUNCT, Q, QR, QV, QL, CLOSED = range(9)
N_STATE = 9
START, RETRO = 1, 2
# The White_Space characters.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def _fresh(c: int) -> tuple[int, int]:
    """State and output when no word is open."""
    if c == SPACE:
        return BETWEEN, 0
    if c == NUMBER:
        return DIGIT, START
    if c == OTHER:
        return PUNCT, START
    if c == QUOTE:
        return Q, START
    return WORD, START


def _step(state: int, c: int) -> tuple[int, int]:
    letter = c in (LETTER, SINGLE, R, V, L, E)
    if state == WORD and letter:
        return WORD, 0
    if state == PUNCT and c in (OTHER, QUOTE):
        return PUNCT, 0
    if state == Q:
        if c in (OTHER, QUOTE):
            return PUNCT, 0
        if c in (SINGLE, R, V, L):
            return {SINGLE: CLOSED, R: QR, V: QV, L: QL}[c], 0
    if state in (QR, QV, QL):
        if c == (L if state == QL else E):
            return CLOSED, 0
        if letter:
            return WORD, RETRO
        to, out = _fresh(c)
        return to, out | RETRO
    return _fresh(c)


class Monoid:
    """The lexical machine's transition monoid: products and actions as tables."""

    def __init__(self) -> None:
        moves = [tuple(_step(s, c)[0] for s in range(N_STATE)) for c in range(N_CLASS)]
        maps = {tuple(range(N_STATE)): 0}
        todo = list(maps)
        while todo:
            m = todo.pop()
            for g in moves:
                n = tuple(g[s] for s in m)
                if n not in maps:
                    maps[n] = len(maps)
                    todo.append(n)
        names = list(maps)
        self.size = len(names)
        self.of_class = np.array([maps[g] for g in moves], np.int16)
        self.act = np.array(names, np.int8)
        self.product = np.empty((self.size, self.size), np.int16)
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                self.product[i, j] = maps[tuple(b[s] for s in a)]
        self.out = np.array([[_step(s, c)[1] for c in range(N_CLASS)] for s in range(N_STATE)], np.uint8)

    def scan(self, totals: np.ndarray) -> np.ndarray:
        """Inclusive parallel prefix products of chunk maps (log2 rounds)."""
        acc, hop = totals.copy(), 1
        while hop < len(acc):
            acc[hop:] = self.product[acc[:-hop], acc[hop:]]
            hop *= 2
        return acc

    def states(self, classes: np.ndarray, chunk: int = 64) -> np.ndarray:
        """The state before every character, the text read in `chunk`-long pieces at once."""
        n = len(classes)
        rows = -(-n // chunk)
        padded = np.zeros(rows * chunk, np.uint8)
        padded[:n] = classes
        steps = np.ascontiguousarray(padded.reshape(rows, chunk).T)
        flat, size = self.product.ravel(), np.int32(self.size)
        before = np.empty((chunk, rows), np.int16)
        acc = np.zeros(rows, np.int16)
        moves = self.of_class.astype(np.int32)
        for t in range(chunk):
            before[t] = acc
            acc = flat.take(acc * size + moves.take(steps[t]))
        entry = np.full(rows, BETWEEN, np.int32)
        entry[1:] = self.act[self.scan(acc)[:-1], BETWEEN]
        out = self.act.ravel().take(before.astype(np.int32) * N_STATE + entry[None, :])
        return out.T.reshape(-1)[:n]


@cache
def _class_table() -> np.ndarray:
    """The class of every code point; those without a category here are unknown: newer tables may make letters of them."""
    t = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for lo in range(0, len(t), 1 << 16):  # a plane at a time: all names at once take 60 MB
        kinds = np.frombuffer("".join(map(unicodedata.category, map(chr, range(lo, lo + (1 << 16))))).encode(), "S2")
        plane = t[lo : lo + (1 << 16)]
        plane[np.char.startswith(kinds, b"L")] = LETTER
        plane[np.char.startswith(kinds, b"N")] = NUMBER
        plane[kinds == b"Cn"] = UNKNOWN
    for ch in WHITE:
        t[ord(ch)] = SPACE
    for chars, c in (("'", QUOTE), ("stmd", SINGLE), ("r", R), ("v", V), ("l", L), ("e", E)):
        for ch in chars:
            t[ord(ch)] = c
    return t


def normalise(text: str) -> str:
    """The tokenizer's normal form, but for runs of white space, which never matter."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


class WordMachine(PairTable):
    """Trie over eight-character blocks; values are word numbers."""

    MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

    def __init__(self) -> None:
        super().__init__()
        self.n_state = 1


class Transducer:
    """Counts and ids of whole texts; keeps what it has compiled between batches.

    `max_words` bounds the compiled words a worker holds; beyond it the word machine starts anew,
    which changes no result.
    """

    PIECE = 1 << 19

    def __init__(self, path: str, max_words: int = 100_000) -> None:
        self.path, self.lib = path, None
        self.merges, self.special = load(path)
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.monoid, self.classes, self.max_words = Monoid(), _class_table(), max_words
        self._reset()

    def _asked(self, text: str) -> np.ndarray:
        """The library's ids of a text that the machines can't read."""
        if self.lib is None:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(self.path)
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.int32)

    def _reset(self) -> None:
        self.words, self.wide = WordMachine(), {}
        self.n_words = self.n_ids = 0
        self.count, self.offset, self.ids = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)

    def _compile(self, words: list[str]) -> np.ndarray:
        """Word numbers of new words, by the machine of merges."""
        counts, ids = self.merges.words([w.encode() for w in words])
        last = np.cumsum(counts) - 1
        a, b = self.n_words, self.n_words + len(words)
        while b > len(self.count):
            self.count, self.offset = np.resize(self.count, 2 * len(self.count)), np.resize(self.offset, 2 * len(self.offset))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.count[a:b], self.offset[a:b] = counts, self.n_ids + last + 1 - counts
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_words, self.n_ids = b, self.n_ids + len(ids)
        return np.arange(a, b, dtype=np.int32)

    def _split(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, word starts and word ends of a text in normal form that ends in a space."""
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        classes = self.classes.take(cp)
        states = self.monoid.states(classes)
        out = self.monoid.out.ravel().take(states.astype(np.int16) * N_CLASS + classes)
        starts = (out & START).astype(bool)
        starts[:-1] |= (out[1:] & RETRO).astype(bool)
        stop = starts | (classes == SPACE)
        ends = (classes != SPACE)
        ends[:-1] &= stop[1:]
        return cp, np.flatnonzero(starts), np.flatnonzero(ends) + 1

    def _advance(self, view: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Word numbers, -1 where a transition is missing; all words step block by block."""
        found = np.full(len(start), -1, np.int32)
        live = np.arange(len(start))
        state = np.zeros(len(start), np.int64)
        k = 0
        while len(live):
            left = n[live] - 8 * k
            last = left <= 8
            take = np.minimum(left, 8)
            block = view[start[live] + 8 * k] & WordMachine.MASKS[take]
            to = self.words.find(state * 16 + np.where(last, take, 0), block)
            found[live[last]] = to[last]
            go = ~last & (to >= 0)
            live, state = live[go], to[go].astype(np.int64)
            k += 1
        return found

    def _learn(self, view: np.ndarray, start: np.ndarray, n: np.ndarray, numbers: np.ndarray) -> None:
        """Add the paths of distinct new words."""
        live, state, k = np.arange(len(start)), np.zeros(len(start), np.int64), 0
        while len(live):
            left = n[live] - 8 * k
            last = left <= 8
            take = np.minimum(left, 8)
            block = view[start[live] + 8 * k] & WordMachine.MASKS[take]
            self.words.add(state[last] * 16 + take[last], block[last], numbers[live[last]])
            live, state, block = live[~last], state[~last], block[~last]
            if len(live):
                to = self.words.find(state * 16, block)
                new = np.flatnonzero(to < 0)
                if len(new):
                    pair = np.empty(len(new), [("s", np.int64), ("b", np.uint64)])
                    pair["s"], pair["b"] = state[new], block[new]
                    keys, back = np.unique(pair, return_inverse=True)
                    fresh = np.arange(self.words.n_state, self.words.n_state + len(keys), dtype=np.int32)
                    self.words.n_state += len(keys)
                    self.words.add(keys["s"] * 16, keys["b"], fresh)
                    to[new] = fresh[back]
                state = to.astype(np.int64)
            k += 1

    def _numbers(self, text: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        narrow = np.zeros(len(cp) + 8, np.uint8)
        narrow[: len(cp)] = cp
        view = np.lib.stride_tricks.as_strided(narrow.view(np.uint8)[:8].view(np.uint64), (len(cp) + 1,), (1,))
        numbers = np.full(len(start), -1, np.int32)
        high = np.flatnonzero(cp > 255)
        slow = np.zeros(len(start), bool)
        if len(high):
            slow[np.searchsorted(start, high, "right") - 1] = True
        fast = np.flatnonzero(~slow)
        s, n = start[fast], (end - start)[fast]
        got = self._advance(view, s, n)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            spans = {text[a : a + b]: i for i, a, b in zip(miss.tolist(), s[miss].tolist(), n[miss].tolist())}
            first = np.fromiter(spans.values(), np.int64, len(spans))
            self._learn(view, s[first], n[first], self._compile(list(spans)))
            got[miss] = self._advance(view, s[miss], n[miss])
        numbers[fast] = got
        if slow.any():
            at = np.flatnonzero(slow)
            words = [text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            new = list(dict.fromkeys(w for w in words if w not in self.wide))
            if new:
                self.wide.update(zip(new, self._compile(new).tolist()))
            numbers[at] = [self.wide[w] for w in words]
        return numbers

    def _piece(self, texts: list[str], want_ids: bool):
        """Counts of normalised texts and all their ids in order."""
        text = " ".join(texts) + " "
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        cp, start, end = self._split(text)
        if self.n_words > self.max_words:
            self._reset()
        numbers = self._numbers(text, cp, start, end)
        counts = self.count[numbers]
        edge = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        per = total[edge[1:]] - total[edge[:-1]]
        if not want_ids:
            return per, None
        at = np.repeat(self.offset[numbers] - total[:-1], counts)
        at += np.arange(total[-1])
        return per, self.ids[at]

    def run(self, texts: list[str | None], want_ids: bool = False):
        """Token counts of texts (null: none) and, if wanted, each one's ids as int32 arrays.

        A text is cut at its special strings, each a token of its own; the parts between are read
        by the machines, about `PIECE` characters at a time, or by the library if they hold a code point
        of an unknown class.
        """
        counts, ids = np.zeros(len(texts), np.int64), [[] for _ in texts] if want_ids else None
        hold: list[str] = []
        which: list[int] = []
        size = 0

        def put(i: int, n: int, part: np.ndarray | None) -> None:
            counts[i] += n
            if want_ids and n:
                ids[i].append(part)

        def flush() -> None:
            nonlocal size
            if which:
                per, flat = self._piece(hold, want_ids)
                parts = np.split(flat, np.cumsum(per)[:-1]) if want_ids else [None] * len(which)
                for i, n, part in zip(which, per.tolist(), parts):
                    put(i, n, part)
            hold.clear()
            which.clear()
            size = 0

        for i, t in enumerate(texts):
            at = 0
            for m in [*self.specials.finditer(t), None] if t and "<" in t else [None] if t else []:
                part = t[at : m.start() if m else len(t)]
                if not part.isascii() and (self.classes.take(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)) == UNKNOWN).any():
                    flush()
                    own = self._asked(part)
                    put(i, len(own), own)
                elif part:
                    part = normalise(part)
                    if size + len(part) > self.PIECE:
                        flush()
                    hold.append(part)
                    which.append(i)
                    size += len(part) + 1
                if m:
                    flush()
                    put(i, 1, np.array([self.special[m[0]]], np.int32))
                    at = m.end()
        flush()
        if want_ids:
            ids = [p[0] if len(p) == 1 else np.concatenate([np.zeros(0, np.int32), *p]) for p in ids]
        return counts, ids


_CACHE: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The compiled machine of a vocabulary file; one in a process."""
    if path not in _CACHE:
        _CACHE[path] = Transducer(path)
    return _CACHE[path]


def release() -> None:
    """Forget the machines: at a task's end, since the worker may wait long for the next one beside other work. Compiling takes a fifth of a second."""
    _CACHE.clear()
