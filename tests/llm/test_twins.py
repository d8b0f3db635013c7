"""The two classifiers against naive twins: loops over pairs and over sentences in place of vectors, and scores recomputed row by row."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from metrascope.llm import quality, queries, toxicity
from metrascope.llm.labelled import label_counts, labelled_sample
from metrascope.llm.common import text_split


def ranked(x, y, rounds, counts, rate=0.05, decay=1e-4):
    """Bradley-Terry, pair by pair: (weights of each feature's bins, threshold)."""
    edges = []
    for j in range(len(x[0])):
        cuts = []
        for k in (0, 1):
            cuts += list(np.quantile([r[j] for r, label in zip(x, y, strict=True) if label == k], [i / quality.BINS for i in range(1, quality.BINS)]))
        edges.append(sorted(set(cuts)))
    place = lambda j, v: sum(v >= e for e in edges[j])
    rows = [[place(j, v) for j, v in enumerate(r)] for r in x]
    theta = [[0.0] * (len(e) + 1) for e in edges]
    m, v = [[0.0] * len(t) for t in theta], [[0.0] * len(t) for t in theta]
    draw = np.random.default_rng(11)
    better, worse = ([int(i) for i in draw.choice([i for i, label in enumerate(y) if label == k], quality.PAIRS)] for k in (1, 0))
    worth = lambda i: sum(theta[j][b] for j, b in enumerate(rows[i]))
    for step in range(1, rounds + 1):
        grad = [[decay * w for w in t] for t in theta]
        for a, b in zip(better, worse, strict=True):
            slope = -1 / (1 + math.exp(worth(a) - worth(b))) / quality.PAIRS
            for j in range(len(theta)):
                grad[j][rows[a][j]] += slope
                grad[j][rows[b][j]] -= slope
        for j, t in enumerate(theta):
            for b in range(len(t)):
                m[j][b] = 0.9 * m[j][b] + 0.1 * grad[j][b]
                v[j][b] = 0.999 * v[j][b] + 0.001 * grad[j][b] ** 2
                t[b] -= rate * (m[j][b] / (1 - 0.9**step)) / (math.sqrt(v[j][b] / (1 - 0.999**step)) + 1e-9)
    order = sorted(range(len(y)), key=worth)
    weight, reached = [counts[k] / y.count(k) for k in (0, 1)], 0.0
    for k, i in enumerate(order):
        reached += weight[y[i]]
        if reached >= counts[0] * (1 - 1e-9):
            break
    k = min(k, len(y) - 2)
    return theta, (worth(order[k]) + worth(order[k + 1])) / 2


@pytest.mark.parametrize("counts", [None, (300, 40)])
def test_pairs_one_by_one(monkeypatch, counts):
    monkeypatch.setattr(quality, "PAIRS", 60)
    draw = random.Random(3)
    y = [int(draw.random() < 0.6) for _ in range(40)]
    x = [[draw.gauss(label, 1.0), draw.gauss(0, 1.0), draw.randrange(3)] for label in y]
    model = quality.fit(np.array(x, float), y, rounds=12, counts=counts)
    theta, threshold = ranked(x, y, 12, counts or [y.count(0), y.count(1)])
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(model.worth, theta, strict=True)) and model.threshold == pytest.approx(threshold, abs=1e-9)


def noisy_or(texts, toxic, rounds, rate=0.15, sparsity=5e-4):
    """The fit, sentence by sentence: (weight by feature, intercept)."""
    bags = []
    for t in texts:
        pieces, index, sentence, _ = toxicity.split_sentences(pa.array([t]))
        sentences = [[] for _ in range(int(sentence[-1]) + 1)]
        for i, s in zip(index.tolist(), sentence.tolist(), strict=True):
            sentences[s] += toxicity.word_features(pieces[i])
        bags.append(sentences)
    seen = {}
    for bag in bags:
        for f in {f for s in bag for f in s}:
            seen[f] = seen.get(f, 0) + 1
    theta = {f: 0.0 for f, n in seen.items() if n >= toxicity.LEAST_DOCS}
    b = -math.log(4 * max(1.0, sum(map(len, bags)) / len(bags)))
    weight = [0.5 / sum(toxic) if t else 0.5 / (len(toxic) - sum(toxic)) for t in toxic]
    moments = {f: [0.0, 0.0] for f in [*theta, "b"]}
    for step in range(1, rounds + 1):
        grad = dict.fromkeys(moments, 0.0)
        for bag, t, w in zip(bags, toxic, weight, strict=True):
            p = [1 / (1 + math.exp(-min(30, max(-30, b + sum(theta.get(f, 0.0) for f in s))))) for s in bag]
            clean = math.prod(1 - min(x, 1 - 1e-12) for x in p)
            outer = -clean / min(1, max(1e-9, 1 - clean)) if t else 1.0
            for s, x in zip(bag, p, strict=True):
                grad["b"] += w * outer * x
                for f in s:
                    if f in theta:
                        grad[f] += w * outer * x
        for f, (one, two) in moments.items():
            one, two = 0.9 * one + 0.1 * grad[f], 0.999 * two + 0.001 * grad[f] ** 2
            moments[f] = [one, two]
            pace = rate / (math.sqrt(two / (1 - 0.999**step)) + 1e-7)
            move = pace * (one / (1 - 0.9**step))
            if f == "b":
                b -= move
            else:
                moved = theta[f] - move
                theta[f] = math.copysign(max(abs(moved) - pace * sparsity, 0), moved)
    return theta, b


def test_sentences_one_by_one():
    draw = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    sentence = lambda bad: " ".join(draw.choices(words, k=5) + (["nasty"] if bad else [])) + "."
    toxic = [k % 3 == 0 for k in range(30)]
    texts = [" ".join(sentence(t and i == 1) for i in range(3)) + ("\nlast line" if k % 4 else "") for k, t in enumerate(toxic)]
    model = toxicity.fit(texts, toxic, rounds=6)
    theta, b = noisy_or(texts, toxic, 6)
    # Features of one hash are one feature in both; weights are held as 32-bit floats.
    assert model.intercept == pytest.approx(b, abs=1e-9)
    assert {f: pytest.approx(w, abs=1e-5) for f, w in theta.items() if abs(w) > 1e-6} == {f: float(model.weights[f]) for f in theta if abs(theta[f]) > 1e-6}
    assert max(theta.values()) > 0


def test_registered_scores_row_by_row(spark, sf, duck):
    """Each row's score from the model's parts: bins' worths through the logistic function, a product over sentences."""
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    train = [d for d in truth if zlib.crc32(str(d).encode()) % 3 != 1]
    rows = labelled_sample(docs, labels, "quality", ~text_split("doc_id", 1, 3), quality.PER_CLASS).collect()
    assert sorted((r["_doc"], r["label"]) for r in rows) == sorted((d, truth[d]) for d in train)
    assert label_counts(docs, labels, "quality", ~text_split("doc_id", 1, 3)) == tuple(sum(truth[d] == k for d in train) for k in (0, 1))
    got = sorted((truth[d], quality.text_features(texts[d] or "")) for d in train)
    model = quality.fit(np.array([x for _, x in got]), [k for k, _ in got])
    for r in queries.QUERIES["op1_quality"](spark, sf).collect():
        x = quality.text_features(texts[r.doc_id] or "")
        margin = sum(float(model.worth[j][sum(v >= e for e in model.edges[j])]) for j, v in enumerate(x))
        assert r.score == pytest.approx(1 / (1 + math.exp(model.threshold - margin)), abs=1e-9)
    model = toxicity.fit_on(docs, labels)
    for r in queries.QUERIES["op10_toxicity"](spark, sf).collect():
        pieces, index, sentence, _ = toxicity.split_sentences(pa.array([texts[r.doc_id] or ""]))
        z = [model.intercept] * (int(sentence[-1]) + 1)
        for i, s in zip(index.tolist(), sentence.tolist(), strict=True):
            z[s] += sum(float(model.weights[f]) for f in toxicity.word_features(pieces[i]))
        assert r.score == pytest.approx(1 - math.prod(1 - 1 / (1 + math.exp(-max(-500, min(500, v)))) for v in z), abs=1e-6)
