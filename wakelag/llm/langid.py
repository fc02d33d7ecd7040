"""Operator 2: language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability is the
sum over all its segmentations into pieces, by the forward algorithm; they are fitted by expectation
maximisation with the forward-backward algorithm. A text's score is the product over its words.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StringType

from wakelag.llm.common import held_out, mapped, plain, small_batches, text_slices, with_fields

#: Documents a language is learned from, at most: those of the smallest hashes. It bounds what is learned from.
SAMPLE = 200
ROUNDS = 3
SMOOTH = 0.02
#: Log probability of a letter outside the vocabulary, alike in all languages.
UNKNOWN = -14.0
#: Letters beyond which a word is scored by itself, with logarithms and in little memory; the product of
#: so many small probabilities still is a normal double.
LONG = 36
#: Words of a lattice while fitting.
PART = 4000
#: Words whose scores a worker keeps.
CACHE = 150_000
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def read_pieces(path: str) -> list[str]:
    """The pieces of a rank file that are letters, with or without a blank ahead, in lower case."""
    out = {}
    with open(path, "rb") as f:
        for line in f:
            try:
                piece = base64.b64decode(line.split()[0]).decode().lower()
            except UnicodeDecodeError:
                continue
            body = piece.removeprefix(" ")
            if body.isalpha() or piece == " ":
                out[piece] = None
    return list(out)


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    found = _WORD.findall(text.lower())
    if "".join(found).isalpha() or not found:
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


class _Lattice:
    """All segmentations of a list of words: edges (source position, target position, piece), by level."""

    def __init__(self, words: list[str], index: dict[str, int]):
        spelt = [" " + w for w in words]
        lengths = np.array([len(w) for w in spelt], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if words else np.zeros(0, dtype=np.int64)
        self.last, self.size = self.first + lengths, int((lengths + 1).sum())
        longest = max(map(len, index), default=1)
        found: list[int] = []  # word, j, i, piece, one after another
        get, put = index.get, found.extend
        for n, w in enumerate(spelt):
            size = len(w)
            for j in range(size):
                put((n, j, j + 1, get(w[j], 0)))
                for i in range(j + 2, min(j + longest, size) + 1):
                    p = get(w[j:i])
                    if p is not None:
                        put((n, j, i, p))
        word, j, i, piece = np.array(found, dtype=np.int32).reshape(-1, 4).T
        order = np.lexsort((word, i))
        self.word, self.end, self.piece = word[order], i[order], piece[order]
        self.src, self.dst = (self.first[self.word] + j[order]).astype(np.int32), (self.first[self.word] + self.end).astype(np.int32)

    def _levels(self) -> Iterator[slice]:
        at = np.flatnonzero(np.diff(self.end, prepend=-1))
        yield from (slice(a, b) for a, b in zip(at, [*at[1:], len(self.end)], strict=True))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        alpha = np.full((self.size, logp.shape[1]), -np.inf)
        alpha[self.first] = 0
        for s in self._levels():
            dst = self.dst[s]
            starts = np.flatnonzero(np.diff(dst, prepend=-1))
            alpha[dst[starts]] = np.logaddexp.reduceat(alpha[self.src[s]] + logp[self.piece[s]], starts, axis=0)
        return alpha

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language; counts: of each word in each language."""
        alpha = self.forward(logp)
        beta = np.full(alpha.shape, -np.inf)
        beta[self.last] = 0
        step = np.zeros((len(self.src), logp.shape[1]))
        for s in reversed(list(self._levels())):  # an edge's target is complete once longer ends are done
            step[s] = logp[self.piece[s]] + beta[self.dst[s]]
            order = np.argsort(self.src[s], kind="stable")
            src = self.src[s][order]
            starts = np.flatnonzero(np.diff(src, prepend=-1))
            beta[src[starts]] = np.logaddexp(beta[src[starts]], np.logaddexp.reduceat(step[s][order], starts, axis=0))
        share = np.exp(alpha[self.src] + step - alpha[self.last][self.word]) * counts[self.word]
        out = np.zeros_like(logp)
        np.add.at(out, self.piece, share)
        return out


class _Scorer:
    """The forward algorithm for many short words at once, on arrays: words x positions.

    Pieces are found by a polynomial hash of 64 bits in two tables of slots.
    """

    BASE, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
    BITS = 21

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.p, self.longest = np.exp(logp), max(map(len, pieces), default=1)
        self.keys = np.zeros(len(pieces) + 1, dtype=np.uint64)
        for length in {len(x) for x in pieces}:
            at = [n for n, x in enumerate(pieces, 1) if len(x) == length]
            codes = self._codes([pieces[n - 1] for n in at], length)
            h = np.zeros(len(at), dtype=np.uint64)
            for i in range(length):
                h = self._step(h, codes[:, i])
            self.keys[at] = h
        self.slots = [np.zeros(1 << self.BITS, dtype=np.int32) for _ in self.MIX]
        left = np.arange(1, len(pieces) + 1)
        for table, mix in zip(self.slots, self.MIX, strict=True):
            where = self._slot(self.keys[left], mix)
            table[where] = left
            left = left[table[where] != left]
        if len(left):
            raise ValueError("the vocabulary is too large for the tables")

    @staticmethod
    def _codes(words: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(w.ljust(length) for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), length).astype(np.uint64)

    def _step(self, h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (h + codes + np.uint64(1)) * self.BASE

    def _slot(self, h: np.ndarray, mix: np.uint64) -> np.ndarray:
        return (((h ^ (h >> np.uint64(29))) * mix) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        first = self.slots[0][self._slot(h, self.MIX[0])]
        first[self.keys[first] != h] = 0
        miss = first == 0
        second = self.slots[1][self._slot(h[miss], self.MIX[1])]
        second[self.keys[second] != h[miss]] = 0
        first[miss] = second
        return first

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities, words x languages."""
        out = np.zeros((len(words), self.p.shape[1]))
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            out[part] = self._same([" " + words[n] for n in part])
        return out

    def _same(self, words: list[str]) -> np.ndarray:
        size = np.array([len(w) for w in words])
        most = int(size.max())
        codes = self._codes(words, most)
        alpha = np.zeros((most + 1, len(words), self.p.shape[1]))
        alpha[0] = 1
        h = np.zeros_like(codes)
        found = []
        for length in range(1, min(self.longest, most) + 1):
            h = self._step(h[:, : most - length + 1], codes[:, length - 1 :])
            found.append(np.ascontiguousarray(self._find(h).T))
        for i in range(1, most + 1):
            alpha[i] = alpha[i - 1] * self.p[found[0][i - 1]]
            for length in range(2, min(self.longest, i) + 1):
                piece = found[length - 1][i - length]
                held = np.flatnonzero(piece)
                if len(held):
                    alpha[i, held] += alpha[i - length, held] * self.p[piece[held]]
        return np.log(alpha[size, np.arange(len(words))])


class Model:
    def __init__(self, langs: list[str], pieces: list[str], logp: np.ndarray):
        self.langs, self.pieces, self.logp = langs, pieces, logp

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "pieces": self.pieces, "logp": self.logp.astype(np.float32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.logp = self.logp.astype(np.float64)

    @classmethod
    def fit(cls, texts: list[tuple[str, str]], pieces: list[str], rounds: int = ROUNDS) -> Model:
        """texts: (language, text)."""
        return cls.learn([(lang, w, n) for lang, text in texts for w, n in Counter(words_of(text)).items()], pieces, rounds, sorted({x for x, _ in texts}))

    @classmethod
    def learn(cls, uses: list[tuple[str, str, int]], pieces: list[str], rounds: int = ROUNDS, langs: list[str] | None = None) -> Model:
        """uses: (language, word, times); a word may come more than once."""
        langs = langs if langs is not None else sorted({x for x, _, _ in uses})
        place = {x: n for n, x in enumerate(langs)}
        seen: dict[str, np.ndarray] = {}
        for lang, w, n in uses:
            seen.setdefault(w, np.zeros(len(langs)))[place[lang]] += n
        words = sorted(seen)
        counts = np.array([seen[w] for w in words]).reshape(len(words), len(langs))
        index = {p: n + 1 for n, p in enumerate(pieces)}
        logp = np.full((len(pieces) + 1, max(1, len(langs))), -np.log(len(pieces) + 1.0))
        logp[0] = UNKNOWN
        if langs and words:
            parts = [(_Lattice(words[at : at + PART], index), counts[at : at + PART]) for at in range(0, len(words), PART)]
            for _ in range(rounds):
                used = sum(lattice.expected(logp, n) for lattice, n in parts)[1:] + SMOOTH
                logp[1:] = np.log(used / used.sum(axis=0))
        return cls(langs, pieces, logp)

    def _score_words(self, words: list[str]) -> np.ndarray:
        if not hasattr(self, "_index"):
            self._index, self._scorer = {p: n + 1 for n, p in enumerate(self.pieces)}, _Scorer(self.pieces, self.logp)
        out = self._scorer.words([w if len(w) <= LONG else "" for w in words])
        for n, w in enumerate(words):
            if len(w) > LONG:
                out[n] = self._score_run(" " + w)
        return out

    def _score_run(self, run: str) -> np.ndarray:
        """The forward algorithm over a very long run, which keeps only as many positions as the longest piece has letters."""
        longest = self._scorer.longest
        past = [np.zeros(len(self.langs))]
        for i in range(1, len(run) + 1):
            got = []
            for back in range(1, len(past) + 1):
                p = self._index.get(run[i - back : i])
                if p is not None or back == 1:
                    got.append(past[-back] + self.logp[p or 0])
            past = [*past[max(0, len(past) - longest + 1) :], np.logaddexp.reduce(got, axis=0)]
        return past[-1]

    def scores(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log probability of each text by language; None where a text has no letter."""
        if not hasattr(self, "_known") or len(self._known) > CACHE:
            self._known, self._table = {}, np.zeros((0, len(self.langs)))
        bags = [Counter(words_of(t)) if t else None for t in texts]
        fresh = list(dict.fromkeys(w for b in bags if b for w in b if w not in self._known))
        added = []
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            added.append(self._score_words(part))
            for n, w in enumerate(part, len(self._known)):
                self._known[w] = n
        if added:
            self._table = np.concatenate([self._table, *added])
        get = self._known.__getitem__
        return [np.fromiter(b.values(), np.float64, len(b)) @ self._table[np.fromiter(map(get, b), np.int64, len(b))] if b else None for b in bags]

    def forget(self) -> None:
        """Drops what scoring has built; later calls build it again."""
        for x in ("_index", "_scorer", "_known", "_table"):
            self.__dict__.pop(x, None)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        langs, probability = [], []
        for s in self.scores(texts):
            if s is None:
                langs.append(UNDETERMINED)
                probability.append(0.0)
            else:
                best = int(np.argmax(s))
                langs.append(self.langs[best])
                probability.append(float(1 / np.exp(np.minimum(s - s[best], 0)).sum()))
        return langs, probability


def sample(df: DataFrame, key: str, text: str, lang: str, most: int = SAMPLE) -> DataFrame:
    """(lang, text): up to `most` labelled texts a language, whatever their length, those of the smallest
    hashes of the id. A row without an id goes by a hash of its text; rows that repeat count once, so no id
    and no text crowds the others out. Counts of rows give how small a hash must be for a row to be looked
    at: about four times as many rows as are taken, which are all that moves."""
    usable = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key))).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text))).alias("h"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).collect()}  # a row a language
    if not counts:
        return usable.select("lang", "text")
    unit = 1 << 40
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(unit, -(-4 * most * unit // max(1, n))))])
    chosen = usable.withColumn("h", F.pmod("h", F.lit(unit))).where(F.col("h") < share[F.col("lang")])
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text")


def fit(df: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the languages of df's labelled rows that are not held out. Words are counted where the
    sample's texts are; their counts, a row a language and word, are what the driver gets.

    Rows without a text or a label teach nothing; of an empty table a model without languages is learned. Each
    distinct label is a language of its own and costs a column of the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bag = Counter(words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * max(1, len(bag)), pa.string()), pa.array([*bag] or [None], pa.string()), pa.array([*bag.values()] or [0], pa.int64())], ["lang", "word", "n"])

    got = mapped(sample(df, key, text, lang), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    rows = list(zip(*(got.column(i).to_pylist() for i in range(3)), strict=True))
    return Model.learn([r for r in rows if r[1] is not None], pieces, langs=sorted({r[0] for r in rows}))


def identify(df: DataFrame, model: Model, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and its posterior probability (0 to 1).

    Only the text is looked at, all of it. `und` with score 0: null texts and texts without a letter, and
    every text if no language was learned. Columns of df with the new names are replaced; rows stay one
    for one.
    """
    small_batches(df.sparkSession)
    names = [x for x in df.columns if x not in (label, score)]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_slices(batch, f"c{at}"):
                langs, scores = model.predict(piece.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*piece.schema.names, "lang", "score"])

    rows = plain(df, names)
    return mapped(rows, run, with_fields(rows.schema.fields, lang=StringType(), score=DoubleType()), model.forget).toDF(*names, label, score)


def default_pieces() -> list[str]:
    import public_tokenizers

    return read_pieces(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
