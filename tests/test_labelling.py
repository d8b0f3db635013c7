"""Failing batches: what is halved, asked again, or given up, and what each request leaves."""

import hashlib
import json

from metrascope.operators import labelling as B
from metrascope.workspace import Workspace


def answers(call, spark, snippets, name, size=4, group=None):
    rows = spark.createDataFrame(snippets, "id string, text string")
    told, records = B.label_batches(rows, call, Workspace(spark, name), "id", "text", group, size)
    return {r.key: r for r in told.collect()}, {r.split_path: r for r in records.collect()}, told


def rules(**more):
    return B.RuleLabeller([("author_use", "used it"), ("unclear", "perhaps")], **more)


def test_children_map_to_exact_snippets(spark):
    """A labeller that answers single snippets only: every request on the way is a record, and leaves name their own snippet."""
    labeller = rules()

    def call(prompt):
        if prompt.count("SNIPPET ") > 1:
            raise RuntimeError("truncated at the limit of output")
        return labeller(prompt)

    got, records, _ = answers(call, spark, [(f"s{i}", "used it" if i == 2 else "nothing") for i in range(4)], "bisect")
    assert {k: (r.split_path, r.label.polarity, r.reason) for k, r in got.items()} == {"s0": ("R.L.L", "topic_only", None), "s1": ("R.L.R", "topic_only", None), "s2": ("R.R.L", "author_use", None), "s3": ("R.R.R", "topic_only", None)}
    assert {p: r["keys"] for p, r in records.items()} == {"R!": ["s0", "s1", "s2", "s3"], "R.L!": ["s0", "s1"], "R.R!": ["s2", "s3"], "R.L.L": ["s0"], "R.L.R": ["s1"], "R.R.L": ["s2"], "R.R.R": ["s3"]}
    assert all((r.response_sha256 is None) == p.endswith("!") and len(r.prompt_sha256) == 64 for p, r in records.items())
    assert records["R.R.L"].response_sha256 == hashlib.sha256(records["R.R.L"].response.encode()).hexdigest()


def test_a_single_snippet_fails_alone_and_transport_is_not_multiplied(spark):
    labeller = rules()

    def call(prompt):
        if "poison" in prompt:
            raise RuntimeError("label ids of another batch")
        if "no line" in prompt:
            raise ConnectionError("no line")
        return labeller(prompt)

    got, records, _ = answers(call, spark, [("a", "x"), ("b", "poison"), ("c", "y"), ("d", None), ("e", "no line"), ("f", "z")], "poison")
    assert got["b"].reason == "RuntimeError: label ids of another batch" and got["b"].label is None and got["b"].split_path == "R.L.R"
    assert {k for k, r in got.items() if r.label is not None} == {"a", "c", "d"} and {got["e"].reason, got["f"].reason} == {"ConnectionError: no line"}
    assert records["R!"]["keys"] in (["a", "b", "c", "d"], ["e", "f"]) and "R.L.R!" in records and "R.R" in records


def test_replies_are_asked_for_again_once(spark):
    """No array at first; then ids that do not cover the batch, which halves it; broken labels, which are told what is wrong."""
    labeller = rules()

    def call(prompt):
        if "deaf" in prompt and "could not be parsed" not in prompt:
            return "I cannot say."
        if "mute" in prompt:
            return "[]"
        labels = json.loads(labeller(prompt))
        if "broken" in prompt:
            again = "violated the schema (snippet 0: confidence out of range)" in prompt
            labels[0]["confidence"] = 0.25 if again else 7
            if again:
                labels[1]["polarity"] = "none"
        return "```json\n" + json.dumps(labels) + "\n```"

    got, records, _ = answers(call, spark, [("a", "deaf"), ("b", "used it")], "deaf")
    assert set(records) == {"R", "R.reask1"} and records["R"].error == "no JSON array found" and got["b"].label.polarity == "author_use" and got["a"].split_path == "R"
    got, records, _ = answers(call, spark, [("a", "mute"), ("b", "used it")], "mute")
    assert set(records) == {"R!", "R.L!", "R.R"} and got["a"].reason == "label ids don't cover the batch" and got["b"].label.polarity == "author_use"
    got, records, _ = answers(call, spark, [("a", "broken"), ("b", "perhaps")], "broken")
    assert set(records) == {"R", "R.schema-retry"}
    assert (got["a"].label.confidence, got["a"].reason) == (0.25, None) and (got["b"].label.polarity, got["b"].label.confidence) == ("unclear", 0.5)


def test_no_snippets(spark):
    got, records, told = answers(rules(), spark, [], "none")
    assert not got and not records and told.columns == ["group", "batch", "key", "split_path", "label", "reason"]
