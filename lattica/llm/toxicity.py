"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_texts
from lattica.llm.samples import held_out, labelled_texts

#: Letters of other scripts that look like Latin ones, and digits that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнгαεορυικντѵ", "aeopcyxijsdhkmtbhraeopuikvtv"))
DIGITS = dict(zip("0134578@$", "oieastbas"))
#: Phrases that make a listed word harmless, beside those that are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum")
GAP = re.compile(r"[\W_]+")
FOLD = str.maketrans(HOMOGLYPHS | DIGITS)
FOLD_L = str.maketrans(HOMOGLYPHS | DIGITS | {"1": "l"})
FULL_WIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}


def foldings(text: str) -> list[str]:
    """The text as words in lower case, each after one space, look-alikes and digits folded.

    A 1 may stand for i or l; texts with a 1 are folded both ways.
    """
    low = text.lower()
    if not low.isascii():
        low = low.translate(FULL_WIDTH)
    ways = [FOLD, FOLD_L] if "1" in low else [FOLD]
    return [" " + GAP.sub(" ", low.translate(w)).strip() + " " for w in ways]


@dataclass
class Lexicon:
    """Stems with weights, exception phrases, and the logistic curve over length-normalised hits."""

    stems: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-6.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for s, w in self.stems.items():
            a.add_word(f" {s}", (len(s) + 1, w))
        for s in self.exceptions:
            a.add_word(f" {s} ", (len(s) + 1, None))
        a.make_automaton()
        return a

    def spans(self, automaton, text: str) -> list[tuple[int, float]]:
        """(start, weight) of the hits in a folded text outside exception phrases; longest at a start."""
        hits: dict[int, tuple[int, float]] = {}
        safe: list[tuple[int, int]] = []
        for end, (n, w) in automaton.iter(text):
            if w is None:
                safe.append((end - n, end))
            elif n > hits.get(end - n + 1, (0, 0.0))[0]:
                hits[end - n + 1] = (n, w)
        return [(at, w) for at, (_, w) in sorted(hits.items()) if not any(a <= at < b for a, b in safe)]

    def features(self, automaton, text: str | None) -> tuple[float, float]:
        """(log of one plus the hits' weight, their weight per hundred words)."""
        if not text or not self.stems:
            return 0.0, 0.0
        best = (0.0, 0.0)
        for folded in foldings(text):
            weight = sum(w for _, w in self.spans(automaton, folded))
            if weight:
                best = max(best, (math.log1p(weight), 100 * weight / max(folded.count(" ") - 1, 1)))
        return best

    def score(self, f: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * f[0] + self.curve[2] * f[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def learn_stems(rows: list[tuple[str, int]], shortest: int = 3, longest: int = 12, cap: int = 5, least: int = 8) -> dict[str, float]:
    """Word beginnings that are commoner in toxic texts, with the log ratio of their rates as weight.

    A word counts `cap` times a text at most.  A beginning's gain is the log-likelihood of its split
    between the labels over chance, halved as words of a text go together, less a Bonferroni charge.
    Of the beginnings along each branch those are chosen whose gains sum highest; of equals the
    longest.  The ratio must be 4 at least, by texts too, of which 3 must be toxic.
    """
    seen = {0: Counter(), 1: Counter()}
    for text, y in rows:
        own = Counter(foldings(text)[0].split())
        seen[y].update({w: min(n, cap) for w, n in own.items()})
    total = {y: max(1, sum(seen[y].values())) for y in seen}
    words = pd.DataFrame({"a": pd.Series(seen[1], dtype=float), "b": pd.Series(seen[0], dtype=float)}).fillna(0.0)
    rate = total[1] / (total[0] + total[1])
    words["w"] = words.index.astype(str)
    levels, charge = {}, 4.0
    for k in range(shortest, longest + 1):
        words = words[words["w"].str.len() >= k]
        sums = words.groupby(words["w"].str[:k])[["a", "b"]].sum()
        sums = sums[sums["a"] >= least]
        words = words[words["w"].str[:k].isin(sums.index)]
        levels[k] = sums
        charge = max(charge, math.log(1 + len(sums)) + 3)
    best: dict[str, tuple[float, list[str]]] = {}
    weights: dict[str, float] = {}
    for k in range(longest, shortest - 1, -1):
        below: dict[str, tuple[float, list[str]]] = {}
        for s, (gain, picked) in best.items():
            g, p = below.get(s[:-1], (0.0, []))
            below[s[:-1]] = (g + gain, p + picked)
        best = {}
        for s, a, b in levels[k].itertuples():
            n = a + b
            gain = 0.0
            ratio = math.log((a + 0.5) / total[1]) - math.log((b + 0.5) / total[0])
            if ratio >= math.log(4):
                gain = (a * math.log(a / (n * rate)) + (b * math.log(b / (n * (1 - rate))) if b else 0.0)) / 2 - charge
            deep, picked = below.get(s, (0.0, []))
            if gain > deep:
                weights[s] = ratio
                deep, picked = gain, [s]
            if deep > 0:
                best[s] = (deep, picked)
    chosen = {s: weights[s] for _, picked in best.values() for s in picked}
    # Words of one text go together, so a stem must also be commoner by texts, and not known from one or two.
    within, texts = {0: Counter(), 1: Counter()}, Counter(y for _, y in rows)
    for text, y in rows:
        own = set(foldings(text)[0].split())
        within[y].update({w[:k] for w in own for k in range(shortest, min(len(w), longest) + 1) if w[:k] in chosen})
    share = lambda s, y: (within[y][s] + 0.5) / (texts[y] + 1)
    return {s: w for s, w in chosen.items() if within[1][s] >= 3 and share(s, 1) >= 4 * share(s, 0)}


def learn_exceptions(lexicon: Lexicon, rows: list[tuple[str, int]], least: int = 5) -> tuple[str, ...]:
    """Two-word phrases around a hit that `least` harmless texts hold and no toxic one."""
    auto, seen = lexicon.automaton(), {0: Counter(), 1: Counter()}
    for text, y in rows:
        phrases = set()
        for f in foldings(text):
            for at, _ in lexicon.spans(auto, f):
                word = f[at + 1 :].split(" ", 2)
                before = f[:at].rsplit(" ", 1)[-1]
                phrases |= {p for p in (f"{before} {word[0]}" if before else "", " ".join(word[:2]).strip() if len(word) > 1 and word[1] else "") if p}
        seen[y].update(phrases)
    return tuple(sorted(p for p, n in seen[0].items() if n >= least and not seen[1][p]))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (weight * (y - p)) - ridge * beta
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(3)
        d = np.linalg.solve(h, g)
        beta = beta + np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 3000) -> Lexicon:
    """Learn stems, exception phrases and curve from at most `per_label` labelled texts (of 64 KB at most) of each label.

    Held-out ids and null labels are left out. With no toxic or no harmless example the lexicon is
    empty, and every text scores alike.
    """
    known = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    got = labelled_texts(docs, known, per_label, id_col, text_col)
    rows = [(t, int(y)) for t, y, _ in got]
    lexicon = Lexicon(learn_stems(rows))
    if not lexicon.stems:
        return lexicon
    lexicon.exceptions = tuple(dict.fromkeys(EXCEPTIONS + learn_exceptions(lexicon, rows)))
    auto = lexicon.automaton()
    x = np.array([lexicon.features(auto, t) for t, _ in rows])
    y = np.array([y for _, y in rows], float)
    taken = Counter(y for _, y in rows)
    weight = np.array([n / taken[int(k)] for _, k, n in got]) * len(got) / sum({k: n for _, k, n in got}.values())
    lexicon.curve = fit_curve(x, y, weight)
    return lexicon


def score_toxicity(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """(id, score) for every row of `df`, or the columns `keep` and score: one narrow pass over whole texts.

    Null and empty texts score as texts without a hit; null ids stay null. Repeated rows score alike, an
    empty table gives no rows. Columns not named are not read. Texts of any length are scored whole, one
    at a time; a task holds some megabytes of them.
    """

    def read():
        auto = lexicon.automaton()
        return lambda texts: [pa.array([lexicon.score(lexicon.features(auto, t)) for t in texts], pa.float64())]

    return map_texts(df, keep or (id_col,), text_col, "score double", read)
