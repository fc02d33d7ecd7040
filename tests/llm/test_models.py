import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import ROWS
from wakelag.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_edges(docs, none):
    pieces = [" ", "a", "b", "c", "e", "th", "the", " the", "der", " der", "und", "ist", "cat"]
    model = langid.fit(docs, pieces)
    rows = langid.identify(docs.select("doc_id", "text", "label", "score"), model).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r["score"] <= 1
        no_letter = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == no_letter
        assert r["label"] == "clash"
    empty = langid.identify(none, langid.fit(none, pieces))
    assert empty.count() == 0 and langid.Model.fit([], pieces).predict(["word"]) == (["und"], [0.0])


def test_forward_sums_every_segmentation():
    model = langid.Model.fit([("x", "abab ba"), ("y", "bb ab")], ["a", "b", "ab", " ", " a", "ba", "aba"], rounds=2)
    p = {s: np.exp(model.logp[n]) for n, s in enumerate(model.pieces, 1)}

    def all_(w):
        return np.ones(2) if not w else sum((p[w[:i]] * all_(w[i:]) for i in range(1, len(w) + 1) if w[:i] in p), np.zeros(2))

    for w in ("ab", "abab", "bbbb", "ababa"):
        assert np.allclose(model._score_words([w])[0], np.log(all_(" " + w)))
        assert np.allclose(model._score_run(" " + w), np.log(all_(" " + w)))


def test_long_pieces_are_summed():
    pieces = langid.default_pieces()
    assert {" international", " disproportionately"} <= set(pieces)
    model = langid.Model.fit([("x", "international law"), ("y", "inter national lawn")], pieces, rounds=2)
    p = {s: np.exp(model.logp[n]) for n, s in enumerate(model.pieces, 1)}
    w = " international"
    past = [np.ones(2)]
    for i in range(1, len(w) + 1):
        past.append(sum((past[j] * p[w[j:i]] for j in range(i) if w[j:i] in p), np.zeros(2)))
    assert np.allclose(model._score_words([w[1:]])[0], np.log(past[-1])) and np.allclose(model._score_run(w), np.log(past[-1]))


def test_language_of_held_out_rows(spark):
    got = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert r > 0.98


def test_samples_hold_every_language_and_length(spark):
    """Rows without an id, rows that repeat and very long texts neither crowd others out nor are left out."""
    rows = [(None, f"der hund {n}", "de") for n in range(3000)] + [(n, f"the dog {n}", "en") for n in range(3000)] + [(7_000_000, "le chien", "fr")] * 3000 + [(8_000_000, "une maison", "fr")] + [(9_000_000, "casa " * 150_000, "es")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = langid.sample(d, "doc_id", "text", "lang", 50).collect()
    by = {x: [r["text"] for r in got if r["lang"] == x] for x in ("de", "en", "fr", "es")}
    assert len(by["de"]) == len(by["en"]) == 50 and len(set(by["de"])) == 50
    held = lambda n: zlib.crc32(str(n).encode()) % 4 == 2
    assert sorted(by["fr"]) == sorted(t for n, t in ((7_000_000, "le chien"), (8_000_000, "une maison")) if not held(n))
    assert held(9_000_000) or len(by["es"][0]) == 750_000
    assert sorted(map(tuple, langid.sample(d.repartition(3), "doc_id", "text", "lang", 50).collect())) == sorted(map(tuple, got))
    labels = spark.createDataFrame([(n, n % 2) for n in range(3000)] + [(None, 1)] * 3000 + [(9_000_000, 1)] * 2, "doc_id long, toxic int")
    got = toxicity.sample(d, labels, "doc_id", "text", "toxic", 100)
    assert len(got) == 100 and got == toxicity.sample(d.repartition(2), labels, "doc_id", "text", "toxic", 100)
    every = toxicity.sample(d, labels, "doc_id", "text", "toxic", 1 << 20)
    assert len(every) == sum(not held(n) for n in [*range(3000), 9_000_000]) and any(len(t) == 750_000 for t, _ in every) != held(9_000_000)


def loops(net, words):
    """The network's logit of one window, number by number."""
    sig, p, h = lambda x: 1 / (1 + np.exp(-x)), {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN
    inputs = []
    for w in words:
        spelt, slots = f"<{w}>", []
        for n in (3, 5):
            for at in range(len(spelt) - n + 1):
                x = n
                for c in spelt[at : at + n]:
                    x = ((x ^ ord(c)) * 0x9E3779B185EBCA87) % (1 << 64)
                    x ^= x >> 31
                slots.append(x % toxicity.SLOTS)
        chars = [sum(p["char"][s][i] for s in slots) / len(slots) for i in range(toxicity.CHAR_DIM)]
        inputs.append([*p["word"][net.place.get(w, 0)], *chars])
    states = [[None] * len(words) for _ in range(2)]
    for d in range(2):
        s = [0.0] * h
        for t in range(len(words)) if d == 0 else range(len(words) - 1, -1, -1):
            x = [sum(a * p["x"][d][i][g] for i, a in enumerate(inputs[t])) + p["b"][d][g] for g in range(3 * h)]
            r = [sum(a * p["h"][d][i][g] for i, a in enumerate(s)) for g in range(3 * h)]
            new = []
            for g in range(h):
                z, reset = sig(x[g] + r[g]), sig(x[h + g] + r[h + g])
                new.append((1 - z) * np.tanh(x[2 * h + g] + reset * r[2 * h + g]) + z * s[g])
            s = states[d][t] = new
    both = [states[0][t] + states[1][t] for t in range(len(words))]
    scores = [sum(p["v"][a] * np.tanh(sum(b[i] * p["a"][i][a] for i in range(2 * h)) + p["ab"][a]) for a in range(toxicity.ATTEND)) for b in both]
    weights = [np.exp(x - max(scores)) for x in scores]
    return sum(w / sum(weights) * sum(b[i] * p["o"][i] for i in range(2 * h)) for w, b in zip(weights, both)) + p["ob"][0]


def test_forward_pass_equals_loops():
    rng = np.random.default_rng(5)
    net = toxicity.Network(["cat", "dog", "idiot"])
    net.p = {k: (v + rng.normal(0, 0.4, v.shape)).astype(np.float32) for k, v in net.p.items()}
    words = [["cat", "a", "straße", "idiot"][n % 4] + "xyz"[: n % 3] for n in range(70)]
    for n in (1, 5, 31, 32, 33, 70):
        got = net.logits([" ".join(words[:n])])[0]
        want = [loops(net, words[:n][s : s + toxicity.WINDOW]) for s in toxicity.starts_of(n)]
        assert np.allclose(got, want, atol=2e-4)
    a, b = net.platt = (1.5, -0.5)
    assert abs(net.scores([" ".join(words)])[0] - 1 / (1 + np.exp(-(a * max(net.logits([" ".join(words)])[0]) + b)))) < 1e-6


def test_gradient():
    net = toxicity.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    vectors, _ = net.vectors(["a", "b", "cc", "ddd"])
    ids, mask, label = rng.integers(0, 4, (5, 3)), np.ones((5, 3)), np.array([1.0, 0, 1])
    mask[3:, 1] = 0
    _, g, _ = net.gradient(vectors, ids, mask, label)
    for k in ("x", "b", "h", "a", "ab", "v", "o", "ob"):
        at = tuple(int(rng.integers(n)) for n in net.p[k].shape)
        kept, both = net.p[k][at], []
        for e in (1e-4, -1e-4):
            net.p[k][at] = kept + e
            both.append(net.gradient(vectors, ids, mask, label)[0])
        net.p[k][at] = kept
        assert abs((both[0] - both[1]) / 2e-4 - g[k][at]) < 1e-3 * max(0.05, abs(g[k][at]))


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 56, 57, 500):
        starts = toxicity.starts_of(n)
        assert {x for s in starts for x in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))


def test_windows_hold_passages_whole():
    size = toxicity.WINDOW // 2 + 1
    for n in (33, 48, 49, 56, 500):
        starts = toxicity.starts_of(n)
        assert all(any(s <= at and at + size <= s + toxicity.WINDOW for s in starts) for at in range(n - size + 1))


def test_long_runs_are_seen_to_their_end():
    fine, rude = "afinedayforawalkintheparkwithallofus", "youidiotgoawayyouidiotgoawaynow"
    runs = [(c + fine * 2 + x + fine, int(x == rude)) for c in "bcdefghijklmnopqrst" for x in (rude, fine)]
    net = toxicity.train(runs[2:], steps=60)
    (toxic, _), (clean, _) = runs[:2]
    assert net.scores([toxic])[0] > 0.5 > net.scores([clean])[0]
    run = "".join(chr(0x4E00 + n) for n in range(500))
    for n in (64, 65, 88, 89, 500):
        units = toxicity.units_of("ab " + run[:n])
        assert units[0] == "ab" and all(any(run[i : i + 5] in u for u in units) for i in range(n - 4))
        assert toxicity.units_of(" ".join(units)) == units


def test_toxicity_edges(docs, none):
    net = toxicity.train([("you idiot go away", 1), ("a fine day", 0)] * 20, steps=10)
    rows = toxicity.score(docs.select("doc_id", "text", "score", "label"), net).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, net).count() == 0
    one = toxicity.train([("only clean", 0)] * 3)
    assert 0 <= one.scores(["x", None, ""])[0] < 0.3
    assert toxicity.train([]).scores(["x", None]) is not None


def test_toxicity_of_held_out_rows(spark):
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    p, y = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert np.mean(p[y == 1][:, None] > p[y == 0][None, :]) > 0.9
