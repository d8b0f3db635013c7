"""Source divergence, decontamination and importance resampling against plain Python, on odd and on hot tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metrascope.llm import decontamination, divergence, importance, words

LONG = " ".join(f"w{i * 7 % 400}" for i in range(20_000))
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def odd():
    """(doc_id, text, lang, source): nulls, empty and very long texts, repeats, other alphabets, a source of a third of all rows."""
    draw = random.Random(1)
    vocabulary = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["ÉCOLE", "école", "İstanbul", "ΣΑΣ", "中文", "K", "K"]
    texts = [" ".join(draw.choices(vocabulary, weights=range(1, 68), k=draw.randrange(0, 60))) for _ in range(150)]
    rows = [(i, t, draw.choice(["en", "fr", None]), "hot" if i % 3 == 0 else draw.choice(["a", "b", "", None])) for i, t in enumerate(texts)]
    rows += [(1, None, "en", "a"), (None, "only null", "en", "a"), (None, "", None, None), (200, LONG, "en", "long"), (200, LONG, "en", "long"), (201, "", "xx", "lonely"), (202, "one-two_three 4\x00five", "xx", "other"), (203, "a\r\nB\tc", "yy", "z")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    rows = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")
    return rows.selectExpr("*", "1 AS term", "2 AS n", "'x' AS row", "3 AS id", "4 AS `a.b`", "5 AS rank", "6 AS score").repartition(5)


def shares(counts, kept, total):
    return {t: 1 + 1_000_000_000 * (counts.get(t, 0) + 5) // (total + 5 * len(kept)) for t in kept}


@pytest.mark.parametrize(("least", "most"), [(30, 50), (2, 3), (10_000, 50)])
def test_divergence(odd, docs, least, most):
    groups, in_docs, in_lang = {}, {}, {}
    for _, text, lang, source in odd:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        in_docs.setdefault(lang or "", Counter()).update(set(terms))
        in_lang.setdefault(lang or "", Counter()).update(terms)
    want = []
    for (lang, source), counts in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        told = {g: shares(c, kept, sum(c[t] for t in kept)) for g, c in groups.items() if g[0] == lang}
        p, q = told[lang, source], shares(in_lang[lang], kept, sum(in_lang[lang][t] for t in kept))
        parts = {"pair": [(s, sum(abs(p[t] - told[lang, s][t]) for t in kept)) for _, s in told if s != source], "term": [(t, p[t] - q[t]) for t in kept if counts[t] and p[t] > q[t]]}
        for part, rows in parts.items():
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            want += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(rows, 1) if part == "pair" or k <= most]
    got = [tuple(r) for r in divergence.divergence_audit(docs, least_docs=least, most_terms=most).collect()]
    assert sorted(got) == sorted(want) and any(r[2] == "term" for r in want) == (least < 10_000)


def test_divergence_of_nothing(docs):
    assert divergence.divergence_audit(docs.where("false")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then sleeps for a while"), (2, "The Quick brown fox jumps over the lazy dog and then wakes"), (3, "tiny"), (4, "two words"), (5, ""), (6, None), (None, "alone without any name at all here now yes"), (10, "same same same same same same same same same same same same"), (2, "two words"), (11, "école d’été"), (12, "the quick brown fox jumps over the lazy dog and then sleeps for a while")]


def contamination(texts, items, window):
    """Every window of every item at every place."""
    asked = {}
    for item, text in items:
        ws = WORD.findall((text or "").translate(LOW))
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            asked.setdefault(tuple(ws[i : i + n]), set()).add(item)
    out = []
    for doc, text in texts:
        ws, hit, found = WORD.findall((text or "").translate(LOW)), set(), set()
        for n in {len(w) for w in asked}:
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in asked:
                    hit.update(range(i, i + n))
                    found |= asked[tuple(ws[i : i + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [10, 4, 1])
def test_decontamination(spark, monkeypatch, window):
    """Passages at the ends of texts, across punctuation, overlapping, repeated, nearly the same; a passage in most documents, with dealing forced."""
    monkeypatch.setattr(decontamination, "_FEW", 3)
    monkeypatch.setattr(decontamination, "_SHARE", 20)
    whole, other = ITEMS[0][1], ITEMS[1][1]
    texts = [(i, f"w{i} {whole} w{i + 1} tail") for i in range(60)]
    texts += [(100, whole), (101, whole.upper().replace(" ", ", ")), (102, "x " + whole[4:]), (103, whole.replace("lazy", "hazy")), (104, f"{whole} {other} {whole}"), (105, None), (106, ""), (107, "tiny two words"), (108, " ".join(["same"] * 40)), (109, LONG + " " + other + " " + LONG), (110, "an ÉCOLE d’été école d’été"), (111, ITEMS[6][1]), (None, whole), (100, whole), (112, "two  words-tiny"), (113, "quick brown fox jumps over the lazy dog and")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS row", "'y' AS token", "2 AS at", "3 AS `w.x`").repartition(4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "9 AS window_id")
    got = sorted((tuple(r) for r in decontamination.decontaminate(rows, items, window=window).collect()), key=str)
    assert got == contamination(texts, ITEMS, window)


def test_decontamination_of_and_by_nothing(spark):
    rows, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.decontaminate(rows.where("false"), items).count() == 0
    assert [tuple(r) for r in decontamination.decontaminate(rows, items.where("false")).collect()] == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]


def test_a_full_bitmap_loses_nothing():
    """All bits set: more passes, none is lost."""
    tokens = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 1000)
    assert decontamination.Bitmap(16, b"\xff" * 8192).holds(tokens).all() and not decontamination.Bitmap(16, b"\0" * 8192).holds(tokens).any()


def test_a_bitmap_holds_what_it_was_made_of(spark):
    tokens = [int(x) for x in np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000)]
    made = decontamination.bitmap_of(spark.createDataFrame([(t,) for t in tokens], "token long"))
    assert made.holds(np.array(tokens)).all()
    assert made.holds(np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 20_000)).mean() < 0.1


def resampled(texts, targets, percent=25):
    """Feature by feature."""
    def found(text):
        ws = WORD.findall((text or "").translate(LOW))
        return len(ws), [zlib.crc32(x.encode()) % 10_000 for x in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]]

    s, t = Counter(), Counter()
    for _, text in texts:
        s.update(found(text)[1])
    for _, text in targets:
        t.update(found(text)[1])
    S, T = float(sum(s.values())), float(sum(t.values()))
    rows = []
    for doc, text in texts:
        n, buckets = found(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in buckets]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fits = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fits, 1):
        r.append(k if k <= percent * len(fits) // 100 else None)
    return [(r[0], r[2], r[3], r[4], r[5] if len(r) > 5 else None) for r in rows]


def test_resampling(spark, odd, docs):
    """Repeated ids tie in score and id, so their ranks may stand either way."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in importance.resample(docs, items).collect()]
    assert sorted(got, key=str) == sorted(resampled([(r[0], r[1]) for r in odd], ITEMS), key=str)
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 10
    assert importance.resample(docs.where("false"), items).count() == 0
    assert importance.resample(docs, items.where("false")).count() == len(odd)


def test_word_places():
    texts = pa.array(["One-two  THREE", None, "", "é É1x\ty", "--", "a" * 5])
    distinct, place, first = words.word_places(texts)
    told = [[distinct[i].decode() for i in place[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert told == [WORD.findall((t.as_py() or "").translate(LOW)) for t in texts]
    distinct, place, first = words.word_places(texts[2:5])
    assert [distinct[i].decode() for i in place] == ["é", "É1x", "y"] and first.tolist() == [0, 0, 3, 3]
    at, text = words.runs(place, first, 2)
    assert at.tolist() == [0, 1] and text.tolist() == [1, 1]
