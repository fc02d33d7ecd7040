"""Operator 8: toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector and as the mean vector of its character pieces; a very long run of letters
enters as overlapping parts. Two gated recurrent
layers read a window of words forwards and backwards, attention pools their states, and a logistic unit
scores the window. All overlapping windows of a text are scored; the highest one counts. Labels are of
documents, so training takes of a toxic document the window that the network finds most toxic so far (of a bag of windows, so that a clean document's worst window counts as clean).
Everything is numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from wakelag.llm.common import held_out, plain, text_slices, with_fields
from wakelag.llm.langid import words_of

#: Labelled documents that are learned from, at most: those of the smallest hashes of the id, whatever their
#: length. It bounds what the driver gets.
SAMPLE = 4000
#: Words of a window, and from one window's start to the next one's; passages of up to 17 words stand whole
#: in some window.
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
#: Slots of hashed character pieces; training documents that give a word a vector of its own.
SLOTS, MIN_DOCS = 16384, 4
#: Letters of a run that is one word at most; longer runs (unspaced script, glued text) are cut into parts of
#: PART letters, one every PART_STRIDE letters, that stand as words.
LETTERS, PART, PART_STRIDE = 64, 24, 12
STEPS, BATCH, RATE, SEED = 600, 48, 0.01, 8
#: Windows of a document that a step looks at; the one found most toxic carries the document's label.
BAG = 4
#: Share of words that lose their own vector, and of those that lose their characters' too, in training.
DROP_WORD, DROP_BOTH = 0.4, 0.05
#: Share of training documents that gives a word its own vector, besides MIN_DOCS; decay of weights a step.
MIN_SHARE, DECAY = 0.005, 2e-4
#: Words whose inputs a worker keeps.
CACHE = 200_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def starts_of(n: int) -> list[int]:
    """Where the windows of n words start; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def units_of(text: str) -> list[str]:
    """The words of a text, runs of more than LETTERS letters as overlapping parts; no letter is left out."""
    words = words_of(text)
    if max(map(len, words), default=0) <= LETTERS:
        return words
    parts = lambda w: [w[s : s + PART] for s in [*range(0, len(w) - PART, PART_STRIDE), len(w) - PART]]
    return [x for w in words for x in ([w] if len(w) <= LETTERS else parts(w))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words' pieces of three and five characters, ends marked, and each piece's word."""
    spelt = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(spelt).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in spelt])
    slots, of = [], []
    for n in (3, 5):
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint64(0x9E3779B185EBCA87)
            h ^= h >> np.uint64(31)
        inside = owner[: len(h)] == owner[n - 1 :]
        slots.append((h[inside] % np.uint64(SLOTS)).astype(np.int64))
        of.append(owner[: len(h)][inside])
    return np.concatenate(slots), np.concatenate(of)


class Network:
    """Parameters by name, the forward pass for windows, and its gradient."""

    def __init__(self, words: list[str]):
        self.place = {w: n + 1 for n, w in enumerate(words)}
        rng, d, h = np.random.default_rng(SEED), WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "word": draw(len(words) + 1, WORD_DIM, scale=0.1), "char": draw(SLOTS, CHAR_DIM, scale=0.1),
            "x": draw(2, d, 3 * h), "b": np.zeros((2, 3 * h), np.float32), "h": draw(2, h, 3 * h),
            "a": draw(2 * h, ATTEND), "ab": np.zeros(ATTEND, np.float32), "v": draw(ATTEND),
            "o": draw(2 * h), "ob": np.zeros(1, np.float32),
        }
        self.platt, self.empty = (1.0, 0.0), 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_table")}

    def vectors(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of words, and what their gradient needs."""
        own = np.array([self.place.get(w, 0) for w in words], dtype=np.int64)
        flat, of = grams(words)
        sizes = np.bincount(of, minlength=len(words))
        order = np.argsort(of, kind="stable")
        flat, of = flat[order], of[order]  # every word has a piece: its marked ends hold one letter at least
        chars = np.add.reduceat(self.p["char"][flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][own], chars], axis=1), (own, flat, sizes)

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. gates: (2, steps, windows, 3 hidden), the inputs' part of the gates by
        direction; mask: (steps, windows), 1 where a word stands."""
        n, b, h = gates.shape[1], gates.shape[2], HIDDEN
        state, wh = np.zeros((2, b, h), np.float32), self.p["h"]
        states, kept = np.zeros((2, n, b, h), np.float32), []
        full = bool(mask.all())
        for t in range(n):
            g = np.stack([gates[0, t], gates[1, n - 1 - t]])
            r_ = np.matmul(state, wh)
            zr = _sigmoid(g[:, :, : 2 * h] + r_[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            new = np.tanh(g[:, :, 2 * h :] + r * r_[:, :, 2 * h :])
            m = None if full else np.stack([mask[t], mask[n - 1 - t]])[:, :, None]
            out = new + z * (state - new)
            if m is not None:
                out = state + m * (out - state)
            if keep:
                kept.append((state, z, r, new, r_[:, :, 2 * h :], m))
            state = out
            states[0, t], states[1, n - 1 - t] = out
        both = np.concatenate([states[0], states[1]], axis=2)
        u = np.tanh(both @ self.p["a"] + self.p["ab"])
        s = u @ self.p["v"] + np.float32(-1e9) * (1 - mask)
        w = np.exp(s - s.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, both)
        logit = pooled @ self.p["o"] + self.p["ob"][0]
        return (logit, (kept, both, u, w, pooled)) if keep else logit

    def gradient(self, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss, gradients by name, and the gradient of the words' vectors. ids: (steps, windows)."""
        p, h = self.p, HIDDEN
        x = vectors[ids]
        gates = np.stack([x @ p["x"][d] + p["b"][d] for d in (0, 1)])
        logit, (kept, both, u, w, pooled) = self.run(gates, mask, keep=True)
        prob = _sigmoid(logit)
        loss = float(-np.mean(label * np.log(prob + 1e-7) + (1 - label) * np.log(1 - prob + 1e-7)))
        n, g = x.shape[0], {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((prob - label) / len(label)).astype(np.float32)
        g["o"], g["ob"] = pooled.T @ dl, dl.sum(keepdims=True)
        dp = dl[:, None] * p["o"]
        dboth = w[:, :, None] * dp
        dw = np.einsum("tbh,bh->tb", both, dp)
        ds = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tba,tb->a", u, ds)
        du = ds[:, :, None] * p["v"] * (1 - u * u)
        g["a"], g["ab"] = np.einsum("tbh,tba->ha", both, du), du.sum(axis=(0, 1))
        dboth += du @ p["a"].T
        dgates = np.zeros_like(gates)
        ahead = np.zeros((2, x.shape[1], h), np.float32)
        for t in range(n - 1, -1, -1):
            state, z, r, new, rec, m = kept[t]
            dout = ahead + np.stack([dboth[t, :, :h], dboth[n - 1 - t, :, h:]])
            past = dout * (1 - m) if m is not None else 0
            dout = dout * m if m is not None else dout
            dz = dout * (state - new) * z * (1 - z)
            dn = dout * (1 - z) * (1 - new * new)
            dr = dn * rec * r * (1 - r)
            dg = np.concatenate([dz, dr, dn], axis=2)
            dh = np.concatenate([dz, dr, dn * r], axis=2)
            g["h"] += np.matmul(state.transpose(0, 2, 1), dh)
            ahead = past + dout * z + np.matmul(dh, p["h"].transpose(0, 2, 1))
            dgates[0, t], dgates[1, n - 1 - t] = dg
        dx = np.zeros_like(x)
        for d in (0, 1):
            g["x"][d] = np.einsum("tbi,tbg->ig", x, dgates[d])
            g["b"][d] = dgates[d].sum(axis=(0, 1))
            dx += dgates[d] @ p["x"][d].T
        dv = np.zeros_like(vectors)
        np.add.at(dv, ids.ravel(), dx.reshape(-1, x.shape[2]))
        return loss, g, dv

    def logits(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The logits of all windows of each text; None where a text has no word."""
        if not hasattr(self, "_known") or len(self._known) > CACHE:
            self._known, self._table = {}, np.zeros((0, 6 * HIDDEN), np.float32)
        docs = [units_of(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for d in docs for w in d if w not in self._known))
        if fresh:
            x, _ = self.vectors(fresh)
            self._table = np.concatenate([self._table, np.concatenate([x @ self.p["x"][d] + self.p["b"][d] for d in (0, 1)], axis=1)])
            self._known |= {w: n for n, w in enumerate(fresh, len(self._known))}
        get = self._known.__getitem__
        ids = [np.fromiter(map(get, d), np.int64, len(d)) for d in docs]
        whole = [(n, s) for n, d in enumerate(ids) if len(d) >= WINDOW for s in starts_of(len(d))]
        out: list[np.ndarray | None] = [None] * len(texts)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        base = np.concatenate([[0], np.cumsum([len(d) for d in ids])])
        got = []
        at = np.array([base[n] + s for n, s in whole], dtype=np.int64)
        for a in range(0, len(at), 1024):
            rows = flat[at[a : a + 1024] + np.arange(WINDOW)[:, None]]
            t = self._table[rows]
            got.append(self.run(np.stack([t[:, :, : 3 * HIDDEN], t[:, :, 3 * HIDDEN :]]), np.ones(rows.shape, np.float32)))
        owner = np.array([n for n, _ in whole], dtype=np.int64)
        if len(owner):
            every = np.concatenate(got)
            edges = np.flatnonzero(np.diff(owner, prepend=-1))
            for x, n in zip(np.split(every, edges[1:]), owner[edges], strict=True):
                out[n] = x
        short = [n for n, d in enumerate(ids) if 0 < len(d) < WINDOW]
        for a in range(0, len(short), 1024):
            part = short[a : a + 1024]
            rows, mask = np.zeros((WINDOW, len(part)), np.int64), np.zeros((WINDOW, len(part)), np.float32)
            for k, n in enumerate(part):
                rows[: len(ids[n]), k], mask[: len(ids[n]), k] = ids[n], 1
            t = self._table[rows]
            for n, x in zip(part, self.run(np.stack([t[:, :, : 3 * HIDDEN], t[:, :, 3 * HIDDEN :]]), mask), strict=True):
                out[n] = np.array([x])
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        a, b = self.platt
        return [float(1 / (1 + np.exp(-np.clip(a * float(x.max()) + b, -60, 60)))) if x is not None else self.empty for x in self.logits(texts)]


def train(texts: list[tuple[str, int]], steps: int = STEPS) -> Network:
    """A network from (text, label); without both labels it gives the share of label 1 to every text."""
    place: dict[str, int] = {}
    docs = []  # numbers of words and the label: a word stands in memory once, however often it is used
    for t, y in texts:
        ids = np.array([place.setdefault(w, len(place)) for w in units_of(t)], dtype=np.int32)
        if len(ids):
            docs.append((ids, int(y)))
    spelt = list(place)
    share = float(np.mean([y for _, y in docs])) if docs else 0.0
    seen = np.zeros(len(spelt), dtype=np.int64)
    for ids, _ in docs:
        seen[np.unique(ids)] += 1
    net = Network(sorted(spelt[n] for n in np.flatnonzero(seen >= max(MIN_DOCS, MIN_SHARE * len(docs)))))
    net.empty = share
    whole = lambda n: " ".join(spelt[w] for w in docs[n][0])
    if len({y for _, y in docs}) < 2:
        net.platt = (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        return net
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(docs))
    tune, learn = order[: len(docs) // 5], order[len(docs) // 5 :]
    if len({docs[n][1] for n in tune}) < 2 or len({docs[n][1] for n in learn}) < 2:
        tune = learn = order
    by = [[n for n in learn if docs[n][1] == y] for y in (0, 1)]
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    hard: dict[int, int] = {}
    for step in range(steps):
        if step and step % (steps // 5) == 0:  # the windows found most toxic so far
            some = rng.permutation(learn)[:1500]
            net.__dict__.pop("_known", None)
            for n, x in zip(some, net.logits([whole(n) for n in some]), strict=True):
                hard[n] = starts_of(len(docs[n][0]))[int(np.argmax(x))]
        chosen = [n for y in (0, 1) for n in rng.choice(by[y], BATCH // 2)]
        windows = []
        for n in chosen:
            all_ = starts_of(len(docs[n][0]))
            bag = [*([hard[n]] if n in hard else []), *rng.choice(all_, BAG)][:BAG]
            windows += [docs[n][0][s : s + WINDOW] for s in bag]
        words = list(dict.fromkeys(w for x in windows for w in x.tolist()))
        at = {w: k for k, w in enumerate(words)}
        words = [spelt[w] for w in words]
        ids, mask = np.zeros((WINDOW, len(windows)), np.int64), np.zeros((WINDOW, len(windows)), np.float32)
        for k, x in enumerate(windows):
            ids[: len(x), k], mask[: len(x), k] = [at[w] for w in x.tolist()], 1
        vectors, (own, flat, sizes) = net.vectors(words)
        lost = rng.random(len(words))
        vectors[lost < DROP_WORD, :WORD_DIM] = 0
        vectors[lost < DROP_BOTH, WORD_DIM:] = 0
        x = vectors[ids]
        top = net.run(np.stack([x @ net.p["x"][d] + net.p["b"][d] for d in (0, 1)]), mask).reshape(BATCH, BAG).argmax(axis=1) + np.arange(BATCH) * BAG
        _, g, dv = net.gradient(vectors, ids[:, top], mask[:, top], np.array([docs[n][1] for n in chosen], np.float32))
        dv[lost < DROP_WORD, :WORD_DIM] = 0
        dv[lost < DROP_BOTH, WORD_DIM:] = 0
        np.add.at(g["word"], own, dv[:, :WORD_DIM])
        np.add.at(g["char"], flat, np.repeat(dv[:, WORD_DIM:] / sizes[:, None].astype(np.float32), sizes, axis=0))
        for k, v in net.p.items():  # Adam
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.001 * (g[k] * g[k] - second[k])
            v *= 1 - DECAY * (k not in ("b", "ab", "ob"))
            v -= RATE * (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.999 ** (step + 1))) + 1e-8)
    net.__dict__.pop("_known", None)
    x = np.array([float(z.max()) for z in net.logits([whole(n) for n in tune])])
    net.platt = _platt(x, np.array([docs[n][1] for n in tune], float))
    net.__dict__.pop("_known", None)
    return net


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of a logistic curve through the documents' highest logits, a little shrunk, by Newton steps
    that are halved until the loss falls."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(c: np.ndarray) -> float:
        t = c[0] * x + c[1]
        return float((np.logaddexp(0, t) - target * t).sum() + 0.005 * c[0] ** 2)

    c = np.array([1.0, 0.0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(c[0] * x + c[1], -50, 50)))
        w = q * (1 - q) + 1e-6
        grad = np.array([((q - target) * x).sum() + 0.01 * c[0], (q - target).sum()])
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        while np.abs(step).max() > 1e-6 and loss(c - step) > loss(c):
            step = step / 2
        c = c - step
    return max(float(c[0]), 0.05), float(c[1])


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = SAMPLE) -> list[tuple[str, int]]:
    """Up to `most` labelled texts (text, label), those of the smallest hashes of the id. Their ids are as
    few, so they are broadcast. Of a document with several labels the largest counts, of an id with several
    texts the first in order; rows without an id, a label or a text teach nothing."""
    unit = 1 << 40
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    usable = usable.select(F.col(key).alias("key"), F.col(label).alias("label"), F.pmod(F.xxhash64(key), F.lit(unit)).alias("h"))
    total = usable.agg(F.approx_count_distinct("key", 0.02)).first()[0]
    near = usable.where(F.col("h") < min(unit, -(-4 * most * unit // max(1, total))))  # about four times as many as are taken
    ids = near.groupBy("key", "h").agg(F.max("label").alias("label")).orderBy("h", "key").limit(most)
    got = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key")
    got = got.groupBy("key", "h", "label").agg(F.min("text").alias("text")).orderBy("h", "key").select("text", "label").toArrow()
    return list(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    return train(sample(docs, labels, key, text, label))


def score(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """df with `out`: the probability (0 to 1) that the text is toxic, from all its windows.

    Null texts and texts without a letter get the share of toxic training documents. Only the text is
    looked at. A column of df named like `out` is replaced; rows stay one for one.
    """
    names = [x for x in df.columns if x != out]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, f"c{at}", 2 << 20):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(net.scores(piece.column(at).to_pylist()), pa.float64())], [*piece.schema.names, "score"])

    rows = plain(df, names)
    return rows.mapInArrow(run, with_fields(rows.schema.fields, score=DoubleType())).toDF(*names, out)
