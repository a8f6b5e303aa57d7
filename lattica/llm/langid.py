"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_texts
from lattica.llm.samples import held_out, labelled_texts

UNDETERMINED = "und"


def letter_bytes() -> np.ndarray:
    """Weight of each byte value in the pool: letters' bytes count, digits, marks and blanks don't."""
    w = np.zeros(256, np.float32)
    w[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return w


@dataclass
class BiGru:
    """Forward and backward gated units over windows of bytes; a softmax labels every position.

    params: for each direction the byte table (256 x 3H: update, reset, candidate), the recurrent
    weights (H x 3H) and the output weights (H x labels); and the output bias.
    """

    labels: list[str]
    hidden: int
    window: int
    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, window: int, seed: int) -> BiGru:
        rng, p = np.random.default_rng(seed), {}
        for d in "fb":
            p[f"t{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            p[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
            p[f"v{d}"] = rng.normal(0, hidden**-0.5, (hidden, len(labels)))
        p["c"] = np.zeros(len(labels))
        return cls(labels, hidden, window, {k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, d: str, x: np.ndarray, keep: bool):
        """States of one direction, by step; x is (window, rows). keep: what backpropagation needs."""
        p, n = self.params, self.hidden
        table, u_gates, u_cand = p[f"t{d}"], np.ascontiguousarray(p[f"u{d}"][:, : 2 * n]), np.ascontiguousarray(p[f"u{d}"][:, 2 * n :])
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((x.shape[1], n), np.float32)
        states, tape = np.empty((*x.shape, n), np.float32), {}
        for t in steps:
            a = table.take(x[t], axis=0)
            g = h @ u_gates
            g += a[:, : 2 * n]
            g *= np.float32(0.5)
            np.tanh(g, out=g)
            g += np.float32(1)
            g *= np.float32(0.5)
            z, r = g[:, :n], g[:, n:]
            rh = r * h
            cand = rh @ u_cand
            cand += a[:, 2 * n :]
            np.tanh(cand, out=cand)
            if keep:
                tape[t] = (h, z, r, rh, cand)
            h = h + z * (cand - h)
            states[t] = h
        return states, tape

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities of every position; x is (window, rows) of bytes."""
        out = self._run("f", x, False)[0] @ self.params["vf"]
        out += self._run("b", x, False)[0] @ self.params["vb"]
        out += self.params["c"]
        out -= out.max(axis=-1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=-1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over weighted positions, and its gradients by backpropagation through time."""
        p, n = self.params, self.hidden
        runs = {d: self._run(d, x, True) for d in "fb"}
        logits = runs["f"][0] @ p["vf"] + runs["b"][0] @ p["vb"] + p["c"]
        logits -= logits.max(axis=-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=-1, keepdims=True)
        total = max(1.0, float(weight.sum()))
        rows = np.arange(x.shape[1])
        loss = float(-(np.log(prob[:, rows, y] + 1e-9) * weight).sum() / total)
        err = prob
        err[:, rows, y] -= 1
        err *= (weight / np.float32(total))[..., None]
        grad = {"c": err.sum((0, 1))}
        for d in "fb":
            states, tape = runs[d]
            grad[f"v{d}"] = np.einsum("tnh,tnk->hk", states, err, optimize=True)
            from_out = err @ p[f"v{d}"].T
            u_g, u_c = p[f"u{d}"][:, : 2 * n], p[f"u{d}"][:, 2 * n :]
            gt, gu = np.zeros_like(p[f"t{d}"]), np.zeros_like(p[f"u{d}"])
            dh = np.zeros((x.shape[1], n), np.float32)
            for t in reversed(list(tape)):
                h, z, r, rh, cand = tape[t]
                dh = dh + from_out[t]
                dc = dh * z * (1 - cand * cand)
                drh = dc @ u_c.T
                dz = dh * (cand - h) * z * (1 - z)
                dr = drh * h * r * (1 - r)
                dg = np.concatenate([dz, dr], axis=1)
                gu[:, : 2 * n] += h.T @ dg
                gu[:, 2 * n :] += rh.T @ dc
                np.add.at(gt, x[t], np.concatenate([dg, dc], axis=1))
                dh = dh * (1 - z) + drh * r + dg @ u_g.T
            grad[f"t{d}"], grad[f"u{d}"] = gt, gu
        return loss, grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, seed: int) -> None:
        """Adam over random batches; x is (rows, window)."""
        rng, pool = np.random.default_rng(seed), letter_bytes()
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        s = {k: np.zeros_like(v) for k, v in self.params.items()}
        for k in range(1, steps + 1):
            at = rng.integers(0, len(x), min(batch, len(x)))
            bytes_ = np.ascontiguousarray(x[at].T)
            _, grad = self.gradients(bytes_, y[at], pool[bytes_])
            now = rate * min(1.0, 2 * (1 - k / (steps + 1)))
            for name, g in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                s[name] = 0.99 * s[name] + 0.01 * g * g
                step = now * (m[name] / (1 - 0.9**k)) / (np.sqrt(s[name] / (1 - 0.99**k)) + 1e-8)
                self.params[name] = (self.params[name] - step).astype(np.float32)

    def documents(self, texts: list[str | None], rows: int = 4096) -> tuple[list[int], list[float]]:
        """Best label's number and pooled probability of each whole text; no text, or one without a letter: -1, 0."""
        raw = [(t or "").encode() for t in texts]
        parts = np.array([-(-len(b) // self.window) for b in raw], np.int64)
        buf = np.zeros(int(parts.sum()) * self.window, np.uint8)
        starts = np.concatenate([[0], np.cumsum(parts)[:-1]]).astype(np.int64)
        for b, s in zip(raw, starts.tolist()):
            buf[s * self.window : s * self.window + len(b)] = np.frombuffer(b, np.uint8)
        grid = buf.reshape(-1, self.window)
        pool = letter_bytes()
        sums = np.zeros((len(grid), len(self.labels) + 1))
        for lo in range(0, len(grid), rows):
            x = np.ascontiguousarray(grid[lo : lo + rows].T)
            w = pool[x]
            sums[lo : lo + rows, :-1] = np.einsum("tn,tnk->nk", w, self.probabilities(x))
            sums[lo : lo + rows, -1] = w.sum(0)
        total = np.zeros((len(texts), sums.shape[1]))
        np.add.at(total, np.repeat(np.arange(len(texts)), parts), sums)
        best, score = [], []
        for t, row in zip(texts, total):
            if not t or row[-1] == 0 or not any(map(str.isalpha, t)):
                best.append(-1)
                score.append(0.0)
            else:
                k = int(row[:-1].argmax())
                best.append(k)
                score.append(float(min(1.0, row[k] / row[-1])))
        return best, score


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
    per_label: int = 400, windows: int = 12_000, hidden: int = 8, window: int = 64, steps: int = 500, batch: int = 256, seed: int = 7,
) -> BiGru | None:
    """Train on at most `per_label` texts (of 64 KB at most) of each label (and `windows` windows in all) outside the held-out ids.

    None if no labelled text has a letter.
    """
    known = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    got = labelled_texts(docs, known.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")), per_label, id_col, text_col)
    got = [(t, y) for t, y, _ in got if any(map(str.isalpha, t))]
    if not got:
        return None
    labels = sorted({y for _, y in got})
    rng, xs, ys = np.random.default_rng(seed), [], []
    each = max(1, windows // len(got))
    for t, y in got:
        b = np.frombuffer(t.encode(), np.uint8)
        b = np.pad(b, (0, max(0, window - len(b))))
        for s in rng.integers(0, len(b) - window + 1, min(each, -(-len(b) // window))):
            xs.append(b[s : s + window])
            ys.append(labels.index(y))
    net = BiGru.fresh(labels, hidden, window, seed)
    if len(labels) > 1:
        net.train(np.stack(xs), np.array(ys), steps, batch, 0.02, seed)
    return net


def predict_languages(df: DataFrame, net: BiGru | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """(id, lang_pred, score) for every row, or the columns `keep`, lang_pred and score, from every byte of its text; one narrow pass.

    `und` with score 0 where the text is null, empty or without a letter, and everywhere if there is
    no network; null ids stay null. Repeated rows give the same prediction, an empty table gives no rows;
    columns not named are not read. Long texts are read whole, a few thousand windows at a time.
    """

    def read():
        def work(texts: list) -> list[pa.Array]:
            best, score = net.documents(texts) if net else ([-1] * len(texts), [0.0] * len(texts))
            return [pa.array([net.labels[k] if k >= 0 else UNDETERMINED for k in best], pa.string()), pa.array(score, pa.float64())]

        return work

    return map_texts(df, keep or (id_col,), text_col, "lang_pred string, score double", read, 256)
