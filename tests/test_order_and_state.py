"""As-of joins, classes of contexts, campaigns with state, schemas from vocabularies: against plain Python."""

import bisect
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metrascope.operators import agreement as A
from metrascope.operators import context as X
from metrascope.operators import labels as B
from metrascope.operators import quotes as Q
from metrascope.operators.asof import last_before
from metrascope.streaming import campaigns as L
from metrascope.streaming.weekly import event_stream
from metrascope.workspace import Workspace


def test_the_last_mark_at_or_before(spark):
    """One key of nearly all rows, keys without marks, null keys and places, marks at one place."""
    draw = random.Random(3)
    points = [(i, "hot" if i % 9 else draw.choice(["a", "b", None]), draw.randrange(5000) if i % 50 else None) for i in range(2000)]
    marks = [("hot", draw.randrange(5000), f"m{i}") for i in range(150)] + [("a", 7, "x"), ("a", 7, "y"), (None, 100, "n"), ("hot", None, "never")]
    got = last_before(spark.createDataFrame(points, "i int, k string, at int"), spark.createDataFrame(marks, "k string, place int, name string"), ["k"], "at", "place", ["name"], Workspace(spark, "asof"), "t", 60).collect()
    assert len(got) == 2000
    by = {}
    for k, place, name in sorted((m for m in marks if m[1] is not None), key=lambda m: (m[0] or "", m[1], m[2])):
        by.setdefault(k, []).append((place, name))
    for r in got:
        held = by.get(r.k, [])
        at = bisect.bisect_right([p for p, _ in held], r.at) - 1 if r.at is not None else -1
        want = (held[at][1], r.at - held[at][0]) if at >= 0 and r.at - held[at][0] <= 60 else (None, None)
        assert (r.name, r.distance) == want


def test_contexts_by_section_and_words(spark):
    texts = {
        "thanks": r"\section*{Acknowledgements} " + "filler " * 110 + "We used ChatGPT to edit.",
        "far": r"\section{Acknowledgements} " + "filler " * 400 + "We used ChatGPT to edit.",
        "denied": r"\section{Intro} The authors did not use ChatGPT in writing.", "plain": "A ChatGPT dataset.", "stated": r"\subsection{On tools} We used ChatGPT.",
        "two": r"\section{Acknowledgments} x \section{Tools} " + "filler " * 110 + "We used ChatGPT.", "grateful": "We are grateful. We used ChatGPT.",
    }
    docs = spark.createDataFrame(list(texts.items()), "arxiv_id string, text string")
    hits = docs.select("arxiv_id", (F.instr("text", "ChatGPT") - 1).cast("long").alias("offset"))
    got = {r.arxiv_id: r for r in X.classified(hits, docs, Workspace(spark, "contexts")).collect()}
    for k, r in got.items():
        text, at = texts[k], texts[k].index("ChatGPT")
        local, before = text[max(0, at - 700) : at + 700], text[max(0, at - 2500) : at]
        told = [bool(re.search(p, local)) for p in (X.DENIAL, X.USE, X.DISCLOSURE, X.THANKS)]
        thanks = told[3] or re.search(r"\\(?:section|subsection)\*?\{[^}]*acknowledg", before, re.I)
        assert r.context_class == (X.NEGATIVE if told[0] and (told[1] or told[2]) else X.ACKNOWLEDGED if thanks and told[2] else X.STATED if told[2] else X.POSSIBLE)
    assert {k: r.context_class for k, r in got.items()} == {"thanks": X.ACKNOWLEDGED, "far": X.STATED, "denied": X.NEGATIVE, "plain": X.POSSIBLE, "stated": X.STATED, "two": X.ACKNOWLEDGED, "grateful": X.ACKNOWLEDGED}
    assert (got["two"].section, got["far"].section, got["denied"].section, got["plain"].section) == (r"\section{Tools}", None, r"\section{Intro}", None)
    told = spark.createDataFrame([(X.POSSIBLE,), (X.STATED,), (X.NEGATIVE,)], "c string").select(X.metadata_class(F.col("c")).alias("c")).collect()
    assert [r.c for r in told] == ["mail_metadata_ai_term", "mail_metadata_ai_use_statement", X.NEGATIVE]


def brute(batches):
    """The ledger, event by event."""
    held, out = {}, []
    for batch in batches:
        for campaign, seq, kind, request, usd in sorted(batch, key=lambda e: (e[1], e[2], e[3] or "")):
            c = held.setdefault(campaign, {"status": None, "cap": None, "used": 0.0, "open": {}, "last": None})
            late = c["last"] is not None and seq < c["last"]
            if late:
                reason = "late"
            elif kind == "created":
                reason = "exists" if c["status"] else None
            elif not c["status"]:
                reason = "unknown campaign"
            elif c["status"] == "closed" and kind != "amended":
                reason = "closed"
            elif kind == "reserved":
                reason = "no amount" if usd is None else "repeated request" if (request or "") in c["open"] else "over the cap" if c["cap"] is not None and c["used"] + usd > c["cap"] else None
            elif kind == "settled":
                reason = "no amount" if usd is None else None if (request or "") in c["open"] else "not open"
            else:
                reason = "open reservations" if kind == "closed" and c["open"] else None
            if reason is None:
                if kind == "created":
                    c.update(status="open", cap=usd)
                elif kind == "reserved":
                    c["open"][request or ""] = usd
                    c["used"] += usd
                elif kind == "settled":
                    c["used"] += usd - c["open"].pop(request or "")
                elif kind == "closed":
                    c["status"] = "closed"
            if c["status"] and not late:
                c["last"] = seq
            out.append((campaign, seq, kind, reason is None, reason, c["status"], round(c["used"], 6), len(c["open"])))
    return sorted(out, key=str)


def test_campaigns_keep_their_state_between_batches(spark, tmp_path):
    """Closing waits for open reservations, what comes late is told, a second run goes on from the first."""
    draw = random.Random(5)
    event = lambda n: (f"c{draw.randrange(4)}", n, draw.choice(["created", "amended", "reserved", "reserved", "settled", "settled", "closed"]), draw.choice(["r1", "r2", None]), draw.choice([1.5, 4.0, None]))
    batches = [[event(n) for n in range(40)], [event(n) for n in range(30, 70)], [event(n) for n in range(70, 110)]]
    batches[0][:3] = [("c0", 0, "created", None, 9.0), ("c0", 1, "reserved", "r1", 5.0), ("c0", 2, "closed", None, None)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, L.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if k:  # the first two files make two batches of one run
                query = L.campaign_ledger(event_stream(spark, str(tmp_path / "in"), files=1)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(((r.campaign, r.seq, r.kind, r.taken, r.reason, r.status, round(r.used, 6), r.open) for r in got), key=str) == brute(batches)
    reasons = {r.reason for r in got}
    assert {"late", "open reservations", "over the cap"} <= reasons


def test_orders_and_packets_of_reviewers(spark):
    papers = spark.createDataFrame([(f"p{i}",) for i in range(60)] + [("p1",)], "arxiv_id string")
    orders = A.reviewer_orders(papers, ["x", "y"], "s", Workspace(spark, "orders")).cache()
    by = {}
    for r in orders.collect():
        by.setdefault(r.reviewer, {})[r.place] = r.arxiv_id
    assert {k: sorted(v) for k, v in by.items()} == {"x": list(range(60)), "y": list(range(60))} and by["x"] != by["y"]
    plants = spark.createDataFrame([("p3",), ("p3",)], "arxiv_id string")
    shown = spark.createDataFrame([("p3", 2), ("p4", 1), ("p4", 4)], "arxiv_id string, excerpts int")
    got = A.packets(orders, plants, shown, "s", 25).collect()
    assert len(got) == 120 and len({r.blind_id for r in got}) == 120 and {(r.packet, r.item) for r in got if r.reviewer == "x"} == {(k // 25, k % 25 + 1) for k in range(60)}
    assert {(r.plant, r.excerpts) for r in got if r.arxiv_id == "p3"} == {(True, 0)} and {r.excerpts for r in got if r.arxiv_id == "p4"} == {5}


def test_quotes_are_unwrapped_to_the_last_command(spark):
    """Fifty levels inside a word, commands that appear by unwrapping, and braces that are no argument: as a loop does it."""
    quotes = ["wo" + r"\emph{" * 50 + "rd" + "}" * 50 + " end", r"\emph{\foo}{x} y", "{a {b} c}", r"\textbf{a \emph{b {c} d} e}", r"\a{\b{\c{}}}\d {x}", r"no \commands{", "}{", "", r"\emph{a}\emph{b}" * 30]

    def plain(q):
        q = re.sub(Q.LINK, r"\1", re.sub(Q.SILENT, " ", q))
        before = None
        while before != q:
            before, q = q, re.sub(Q.COMMAND, r"\1", q)
        return re.sub(Q.BARE, " ", q).translate(str.maketrans({"{": "", "}": "", "$": "", "~": " "}))

    got = spark.createDataFrame(list(enumerate(quotes)), "i int, q string").select("i", Q.detex_column(F.col("q")).alias("q")).collect()
    assert [r.q for r in sorted(got)] == [plain(q) for q in quotes] and plain(quotes[0]) == "word end"


def follows(value, schema):
    """Whether a value follows a JSON schema as these are."""
    kind = schema["type"]
    if kind == "object":
        return isinstance(value, dict) and set(schema["required"]) <= set(value) and set(value) <= set(schema["properties"]) and all(follows(v, schema["properties"][k]) for k, v in value.items())
    if kind == "array":
        return isinstance(value, list) and len(value) >= schema.get("minItems", 0) and all(follows(v, schema["items"]) for v in value)
    types = {"string": str, "boolean": bool, "integer": int, "number": (int, float)}
    return isinstance(value, types[kind]) and (kind == "boolean" or not isinstance(value, bool)) and value in schema.get("enum", [value])


_ONE = {
    "polarity": st.sampled_from([*B.POLARITIES, "none", 3]), "tools": st.sampled_from([[], ["ChatGPT"], "ChatGPT", [1]]), "models": st.sampled_from([[], ["x"]]),
    "categories": st.sampled_from([[], ["ideation"], ["magic"], ["figures", "ideation"]]), "epistemic_impact": st.sampled_from([*B.IMPACTS, "huge"]),
    "locations": st.sampled_from([["body"], [], ["moon"], ["abstract", "body"]]), "confidence": st.sampled_from([0, 0.5, 1, True, "1", 2]), "quote": st.sampled_from(["", "q", None]),
    "flags": st.sampled_from([{"catalytic": False}, {"catalytic": True}, {}, {"catalytic": 1}, {"other": True}]),
}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.fixed_dictionaries(_ONE, optional={"more": st.just(1)}), min_size=80, max_size=80))
def test_what_is_valid_follows_the_schema(spark, labels):
    """A label that validation takes follows the generated schema; what breaks the schema is refused."""
    schema = B.label_schema(numbered=False)
    rows = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(labels)], "i int, label_json string").withColumn("snippet", F.lit("q"))
    for r in B.validate_labels(rows).select("i", "reason").collect():
        assert r.reason is not None or follows(labels[r.i], schema)


def test_the_schema_is_made_from_the_vocabularies(spark):
    schema = B.label_schema()
    assert schema["required"] == ["id", *B.KEYS] and schema["properties"]["categories"]["items"]["enum"] == sorted(B.CATEGORIES) and schema["properties"]["flags"]["required"] == sorted(B.FLAGS)
    assert "additionalProperties" not in json.dumps(B.reply_schema(closed=False)) and json.dumps(B.reply_schema()).count('"additionalProperties": false') == 3
    label = {"id": 0, "polarity": "topic_only", "tools": [], "models": ["m"], "categories": [], "epistemic_impact": "not_applicable", "locations": ["body"], "confidence": 0.5, "quote": "", "flags": {"catalytic": False}}
    (r,) = spark.createDataFrame([(json.dumps({"labels": [label]}),)], "reply string").select(B.read_replies(F.col("reply")).alias("labels")).collect()
    assert [x.asDict(True) for x in r.labels] == [label]
    with pytest.raises(KeyError):
        B.struct_of({"type": "null"})
