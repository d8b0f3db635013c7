"""Text expressions, lexicon, quotes and providers on short strings."""

import itertools
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metrascope.functions import text as X
from metrascope.operators import lexicon as L
from metrascope.operators import providers as V
from metrascope.operators import quotes as Q


def one(spark, expression, *values):
    """The expression over a column ``c`` of the values."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").orderBy("i")
    got = [r[0] for r in df.select(expression(F.col("c"))).collect()]
    return got if len(values) > 1 else got[0]


@pytest.mark.parametrize(
    ("source", "left"),
    [
        ("a % gone\nb", "a \nb"), (r"50\% stays", r"50\% stays"), (r"\url{a%20b} % x", r"\url{a%20b} "), (r"\begin{comment}x\end{comment}y", "y"),
        (r"\begin{comment}never closed", ""), (r"a\iffalse b\fi c", "a c"), ("a\\end{document}\nrest", "a\\end{document}"), (r"\href{u%1}{t}%", r"\href{u%1}{t}"), ("", ""),
    ],
)
def test_strip_comments(spark, source, left):
    assert one(spark, X.strip_comments, source) == left


def test_accents(spark):
    assert one(spark, X.plain_accents, r"Universit\'e~Claude", r"\v{C}ech", r"\thanks{me}") == ["Universite Claude", "Cech", r"\thanks{me}"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1 \né", max_size=30), min_size=1, max_size=20))
def test_positions_are_those_of_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").orderBy("i")
    got = [[(h.offset, h.matched) for h in r[0]] for r in df.select(X.match_positions(F.col("c"), "[ab]+1?")).collect()]
    assert got == [[(m.start(), m.group()) for m in re.finditer("[ab]+1?", t)] for t in texts]


LEXICON = [
    ("We thank ChatGPT for help with editing.", {("ChatGPT", "ack_usage")}),
    ("No AI was used; we did not use ChatGPT.", {("ChatGPT", "negation_context"), ("AI-bare", "negation_context")}),
    ("Université Claude Bernard Lyon", {("Claude", "known_fp")}),
    ("a lean argument and a Lean one", set()), ("verified in Lean by computation", {("Lean", "usage_context")}),
    ("GPT-4o wrote this", {("GPT", "plain")}), ("Bard of Avon", set()), ("the bard, an AI chatbot", {("Bard", "plain"), ("chatbot", "plain")}),
    ("AI Usage: Claude Code", {("Claude", "disclosure_genre"), ("AI-compound", "disclosure_genre"), ("AI-bare", "disclosure_genre")}), ("", set()),
    ("the \u212aimi and chatgpt\u017f; é Claude é CLAUDE code", {("Claude", "plain")}), ("o3-mini for proofs", {("o-series", "plain")}),
]


def test_lexicon(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LEXICON)], "i int, c string")
    told = {}
    for r in L.scan(df, ["i"], "c", tex=False).collect():
        told.setdefault(r.i, set()).add((r.term, r.rule_class))
        text = LEXICON[r.i][0]
        assert text[r.offset : r.offset + len(r.matched)] == r.matched and r.context == text[max(0, r.offset - 400) : r.offset + 400]
    for i, (_, found) in enumerate(LEXICON):
        assert found <= told.get(i, set()) if found else i not in told


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["ChatGPT ", "GPT-4o", "an AI", "Lean 4", "lean", "o1 mini", "help of an AI", "é", "ſ", "\n", " ", "used ", "magma", "a Magma", "no LLMs", ".", "Claude  Code", "claude"]), max_size=9).map("".join), min_size=1, max_size=12))
def test_matches_are_those_of_all_patterns(spark, texts):
    """Prefilter and positions against Python's matches of every pattern, licences aside."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = {(r.i, r.term, r.offset, r.matched) for r in L.scan(df, ["i"], "c", tex=False).collect()}
    want = {(i, n, m.start(), m.group(), bool({"a", "c"} & set(marks))) for i, t in enumerate(texts) for n, _, marks, p in L.TERMS for m in re.finditer(p, t, re.IGNORECASE if "i" in marks else 0)}
    assert {w[:4] for w in want if not w[4]} <= got <= {w[:4] for w in want}


def test_every_term_has_necessary_strings():
    assert all(min(map(len, L.necessary(p))) > 1 for _, _, _, p in L.TERMS)
    assert L.necessary(r"\b(?:Google\s+)?Gemini\b") == ["Gemini"] and L.necessary(r"ab?|cd") == ["a", "cd"] and L.necessary(r"x?") == [""]


def test_lexicon_has_all_tiers():
    tiers = [t for _, t, _, _ in L.TERMS]
    assert {t: tiers.count(t) for t in set(tiers)} == {"llm": 47, "generic": 4, "ml": 5, "prover": 7, "cas": 13}


def test_scan_and_flags(spark):
    docs = spark.createDataFrame([(1, "We used ChatGPT % not Gemini\n here"), (2, "nothing"), (3, "Pierre Claude wrote"), (4, None)], "id int, text string")
    told = L.scan(docs, ["id"])
    assert {(r.id, r.term, r.rule_class) for r in told.collect()} == {(1, "ChatGPT", "usage_context"), (3, "Claude", "known_fp")}
    assert [r.id for r in L.flagged(told, "id").collect()] == [1]


def test_metadata_keeps_clean_documents(spark):
    docs = spark.createDataFrame([(1, "On GPT-4", None), (2, "Primes", "10 pages")], "id int, title string, comments string")
    assert {(r.id, r.kind, r.term) for r in L.scan_metadata(docs, "id", ["title", "comments"]).collect()} == {(1, "meta:title", "GPT"), (2, None, None)}


QUOTES = [
    ("we used the tool for proofreading", "Here WE used the  tool\nfor proof-\nreading.", True, "exact"),
    ("a well-known model assistant helped", "a wellknown model assistant helped", True, "exact-dehyphen"),
    ("short one", "short one", False, "quote-too-short"),
    ("", "text", False, "no-text"),
    (r"we \emph{used} \href{http://x}{the tool} for proofs\cite{a}", "we used the tool for proofs", True, "exact"),
    ("the efficient ﬁnding of a proof", "the efficient finding of a proof", True, "exact"),
    ("entirely different words stand here", "nothing of that kind at all in this text", False, "anchor-miss"),
    ("we used the assistant for checking all the proofs", "we used the assistant tor checking a1l the proofs", True, "fuzzy"),
    ("we used the assistant only to brainstorm ideas", "we used the assistant and then wrote a much longer unrelated sentence about cats", False, "fuzzy"),
]


def test_quotes(spark):
    df = spark.createDataFrame([(i, q, t) for i, (q, t, _, _) in enumerate(QUOTES)], "i int, quote string, text string")
    got = {r.i: (r.matched, r.method) for r in Q.match_quotes(df).collect()}
    assert got == {i: (m, k) for i, (_, _, m, k) in enumerate(QUOTES)}


def test_quotes_render(spark):
    got = one(spark, Q.detex_column, r"\emph{a \textbf{b}}", r"x\label{ChatGPT} y", "a~b $c$", r"\href{http://u}{the link} \LaTeX")
    assert [" ".join(x.split()) for x in got] == ["a b", "x y", "a b c", "the link"]


def changes(quote, text):
    """By definition: the longest common subsequence with each stretch."""

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(zip(b, row[:-1], row[1:], strict=True), lambda left, t: max(left, t[2], t[1] + (t[0] == x)), initial=0)][1:]
        return row[-1]

    return [min(len(quote) + (j - i) - 2 * common(quote, text[i:j]) for i in range(j + 1)) for j in range(len(text) + 1)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc ", min_size=1, max_size=9), st.text(alphabet="abc ", max_size=14))
def test_least_changes(quote, text):
    assert Q.least_changes(quote, text).tolist() == changes(quote, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "tool", "we", "used", "proofs", "a"]), min_size=3, max_size=9), st.lists(st.sampled_from(["the", "tool", "we", "used", "proofs", "xx", "teh", "a"]), max_size=14))
def test_the_bound_loses_no_match(quote, text):
    quote, text = " ".join(quote), " ".join(text)
    free, (bounded, _) = Q.near_score(quote, text), Q.near_scores([quote, quote], [text, quote], True)
    assert (free >= Q.THRESHOLD) == (bounded >= Q.THRESHOLD) and (free < Q.THRESHOLD or free == bounded)


def test_providers(spark):
    tools = ["ChatGPT", "GitHub Copilot", "Claude Opus", "Lean 4", "o3", "Deep Think", "my model", None]
    assert one(spark, V.provider_of, *tools) == ["OpenAI", "Microsoft", "Anthropic", None, "OpenAI", "Google", "Other/unclear", None]
    assert one(spark, V.is_agentic, "Claude Code", "ChatGPT", None) == [True, False, False]


def test_small_expressions(spark):
    assert one(spark, lambda c: X.middle_cut(c, 9, "|"), "abcdefghij", "abc") == ["abcdef|hij", "abc"]
    assert one(spark, lambda c: X.is_grounded(c, F.lit("so  we\nasked")), "we asked", "they asked", "", None) == [True, False, False, False]
    assert one(spark, lambda c: X.protocol_hash(c, F.lit(1)), None, "a") == [one(spark, lambda c: F.sha2(F.lit("None|1"), 256), "x"), one(spark, lambda c: F.sha2(F.lit("a|1"), 256), "x")]
    assert one(spark, lambda c: X.decode_text(F.unhex(c)), "C3A9", "E9") == ["é", "é"]
    assert one(spark, lambda c: X.sniff_format(F.unhex(c)), "25504446", "1F8B08", "", "6162") == ["pdf", "gzip", "empty", "other"]


def test_the_whole_lexicon_as_python_reads_it(spark):
    """All terms in texts of their own case, with licences and false positives near and far: hits and classes as Python's re gives them."""
    draw = random.Random(6)
    samples = {"o-series": "o3-mini", "Bard": "Google Bard", "Llama": "Llama 3", "GLM": "GLM-4", "Perplexity": "Perplexity Pro", "AI-compound": "AI-assisted", "AI-bare": "AI", "GPT": "GPT-4o", "ERNIE": "Wenxin", "Tongyi": "Qianwen", "ChatGLM": "Zhipu", "Co-Scientist": "co-scientist", "proof assistant": "formally verified", "PARI/GP": "PARI/GP", "Macaulay2": "Macaulay 2", "large language model": "LLMs", "chatbot": "chat-bots", "Mathematica": "Wolfram Alpha"}
    words = [samples.get(n, n) for n, *_ in L.TERMS]
    around = ["we used", "the prompt", "is", "software", "Université", "a", "spectral", "type", "not use", "without help", "thanks to", "AI disclosure", "Bernard", "Heinlein wrote", "filler " * 45, "x"]
    text = lambda k: " ".join([draw.choice(around), words[k % len(words)].upper() if draw.random() < 0.2 else words[k % len(words)], draw.choice(around), draw.choice(words), draw.choice(around)])
    texts = [text(k) for k in range(3 * len(words))] + ["Université Claude Bernard", "the spectral GAP, by software", "Marie Claude and Claude Code", "in a magma. " + "filler " * 50 + "we used Magma software"]
    flags = lambda any_case: re.IGNORECASE if any_case else 0
    want = set()
    for i, t in enumerate(texts):
        for name, tier, marks, pattern in L.TERMS:
            for m in re.finditer(pattern, t, flags("i" in marks)):
                a, b = m.span()
                near = t[max(0, a - L.LICENCE_RADIUS) : a] + " " + t[b : b + L.LICENCE_RADIUS]
                if "a" in marks and not re.search(L.AI_CONTEXT, near, re.I) or "a" not in marks and "c" in marks and not re.search(L.CONTEXT, near, re.I):
                    continue
                low = max(0, a - L.CLASS_RADIUS)
                local = t[low : b + L.CLASS_RADIUS]
                false = any(f.start() + low <= b and f.end() + low >= a for mark, p in L.KNOWN_FALSE for f in re.finditer(p, local, flags(mark)))
                said = lambda p: re.search(p, local, re.I)  # noqa: B023, E731
                kind = "known_fp" if false else "negation_context" if said(L.NEGATION) else "disclosure_genre" if said(L.DISCLOSURE) else "plain"
                if kind == "plain":
                    kind = {(True, True): "ack_usage", (True, False): "ack_context", (False, True): "usage_context"}.get((bool(said(L.ACKNOWLEDGEMENT)), bool(said(L.USAGE))), kind)
                want.add((i, name, tier, a, m.group(), kind))
    got = {(r.i, r.term, r.tier, r.offset, r.matched, r.rule_class) for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "i int, c string"), ["i"], "c", tex=False).collect()}
    assert got == want
    assert {n for _, n, *_ in want} == {n for n, *_ in L.TERMS} and len({k for *_, k in want}) == 7
