"""Batches of snippets put to a labeller, with failing batches halved until single snippets fail.

The labeller is any function from a prompt to a reply; a rule stands in where
none is passed. Requests of all batches advance together, round by round: a
round puts its prompts to the labeller on the executors and is written before
anything is made of it, so no prompt is sent twice by what reads it later. Of
the texts a round keeps one copy, the snippets of its requests; prompts leave
their digests. From the replies follow, as expressions, results and the requests
of the next round:

* a reply that is no array is asked for once more (path ``.reask1``);
* a batch whose request failed for its size, or whose labels do not cover its
  snippets, is halved: ``R`` becomes ``R.L`` and ``R.R``, in stable order;
* labels that break the rules are asked for once more with what is wrong
  (``.schema-retry``), and of each snippet the valid one counts;
* other failures, such as of transport, and single snippets end with a reason.

With batches of n snippets there are at most 2 + 2 log2(n) rounds. Each request
leaves one record: its path (``!`` marks a failure), the keys of its snippets
in the order of their numbers, digests of prompt and reply, and the reply.

Defined results: null snippets count as empty; repeated keys are snippets of
their own; batches end with their group; no snippets give no requests.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .labels import reply_ids_complete, validate_labels
from .numbering import numbered
from .replies import json_array
from .sessions import BATCH

# What in a failure's text tells that a smaller batch may do.
SPLITTABLE = ("truncated", "expected", "label ids", "don't cover", "duplicate", "no JSON array", "control character")
HEADER = "Label each snippet. Reply with a JSON array of one object for each, with its number as id.\n"
MARK, END = "----------\nSNIPPET ", "----------\nOnly the JSON array.\n"
REASK = "\nYour previous reply could not be parsed. Reply with only the JSON array."

Labeller = Callable[[str], str]


class RuleLabeller:
    """A stand-in for a model: the first rule that a snippet meets gives its polarity, and its match the quote.

    Prompts of over ``most_chars`` characters are refused as too long to answer.
    """

    def __init__(self, rules: Sequence[tuple[str, str]], most_chars: int | None = None):
        self.rules, self.most_chars = [(polarity, re.compile(pattern)) for polarity, pattern in rules], most_chars

    def __call__(self, prompt: str) -> str:
        if self.most_chars is not None and len(prompt) > self.most_chars:
            raise RuntimeError("truncated: the prompt is too long for an answer")
        parts = re.split(rf"{MARK}(\d+):\n", prompt.split(END)[0])
        return json.dumps([self.label(int(k), text) for k, text in zip(parts[1::2], parts[2::2], strict=True)])

    def label(self, number: int, text: str) -> dict:
        polarity, quote = next(((p, m[0]) for p, rule in self.rules if (m := rule.search(text))), ("topic_only", ""))
        use = polarity == "author_use"
        return {"id": number, "polarity": polarity, "tools": [], "models": [], "categories": ["unspecified"] if use else [], "epistemic_impact": "undetermined" if use else "not_applicable", "locations": ["unknown"], "confidence": 0.5, "quote": quote, "flags": {"catalytic": False}}


_ITEMS = "array<struct<place: int, key: string, snippet: string>>"
_ASKED = f"_group string, batch long, path string, kind string, items {_ITEMS}, complaint string"


def requests(snippets: DataFrame, work: Workspace, key: str, snippet: str, group: str | None = None, size: int = BATCH) -> DataFrame:
    """(_group, batch, path, kind, items, complaint): the batches of at most ``size`` snippets of a group, by key."""
    rows = snippets.select((F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("_group"), F.col(key).alias("_key"), F.coalesce(F.col(snippet), F.lit("")).alias("snippet"))
    placed = numbered(rows, ["_key"], work, "numbered", ["_group"]).withColumn("number", F.col("number") - 1)
    item = F.struct(F.pmod("number", F.lit(size)).cast("int").alias("place"), F.col("_key").cast("string").alias("key"), "snippet")
    told = placed.groupBy("_group", F.floor(F.col("number") / size).alias("batch")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return told.select("_group", "batch", F.lit("R").alias("path"), F.lit("ask").alias("kind"), F.col("items").cast(_ITEMS).alias("items"), F.lit(None).cast("string").alias("complaint"))


def prompt_of(items: Column, complaint: Column, header: str = HEADER) -> Column:
    each = F.transform(items, lambda x, i: F.concat(F.lit(MARK), i.cast("string"), F.lit(":\n"), x["snippet"], F.lit("\n")))
    return F.concat(F.lit(header), F.array_join(each, ""), F.lit(END), F.coalesce(complaint, F.lit("")))


def _calls(call: Labeller, columns: Sequence[str]):
    """Adds prompt_sha256, reply and error to each row; its last column is the prompt, which goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, replies, errors = [], [], []
            for prompt in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    reply, error = call(prompt), None
                except Exception as e:  # what a labeller raises is a result
                    reply, error = None, f"{type(e).__name__}: {str(e)[:200]}"
                digests.append(hashlib.sha256(prompt.encode()).hexdigest())
                replies.append(reply)
                errors.append(error)
            yield pa.record_batch([*batch.columns[:-1], *[pa.array(x, pa.string()) for x in (digests, replies, errors)]], [*columns[:-1], "prompt_sha256", "reply", "error"])

    return run


def _answered(asked: DataFrame, call: Labeller, header: str) -> DataFrame:
    """The requests with prompt_sha256, reply and error."""
    rows = asked.withColumn("prompt", prompt_of(F.col("items"), F.col("complaint"), header))
    return rows.mapInArrow(_calls(call, rows.columns), f"{_ASKED}, prompt_sha256 string, reply string, error string")


def _judged(answered: DataFrame) -> DataFrame:
    """The requests with labels (arrays of variants, by number) or the problem, and what is to be done: done, reask, split or end."""
    value, problem = json_array(F.col("reply"))
    rows = answered.withColumns({"_value": value, "_parse": F.when(F.col("error").isNull(), problem)})
    labels = F.col("_value").cast("array<variant>")
    ids = F.transform(labels, lambda v: F.try_variant_get(v, "$.id", "int"))
    rows = rows.withColumn("_n", F.size("items")).withColumns({"labels": labels, "_ids": ids})
    cover = F.when(F.col("error").isNull() & F.col("_parse").isNull() & ~reply_ids_complete(F.col("_ids"), F.col("_n")), "label ids don't cover the batch")
    rows = rows.withColumn("problem", F.coalesce("error", "_parse", cover))
    smaller = (F.col("_parse").isNotNull() | reduce(Column.__or__, [F.contains("problem", F.lit(x)) for x in SPLITTABLE])) & (F.col("_n") > 1)
    todo = (
        F.when(F.col("problem").isNull(), "done").when(F.col("kind") == "schema", "end")
        .when(F.col("_parse").isNotNull() & (F.col("kind") == "ask"), "reask").when(smaller, "split").otherwise("end")
    )
    return rows.withColumn("todo", todo)


def _root(path: Column) -> Column:
    return F.regexp_replace(path, r"\.(reask1|schema-retry)", "")


def _records(judged: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c), 256)
    path = F.concat("path", F.when(F.col("problem").isNotNull() & (F.col("todo") != "reask"), "!").otherwise(""))
    return judged.select(F.col("_group").alias("group"), "batch", path.alias("split_path"), F.transform("items", lambda x: x["key"]).alias("keys"), "prompt_sha256", sha("reply").alias("response_sha256"), F.col("reply").alias("response"), F.col("problem").alias("error"))


def _labels(judged: DataFrame) -> DataFrame:
    """A row of each snippet of an answered request: reason (null if its label is valid) and label."""
    rows = judged.where("todo = 'done'").select("_group", "batch", "path", "kind", "items", F.explode("labels").alias("_one"))
    number = F.try_variant_get("_one", "$.id", "int")
    bare = F.to_json(F.map_filter(F.col("_one").cast("map<string,variant>"), lambda k, _: k != "id"))
    rows = rows.withColumns({"_item": F.get("items", number), "number": number, "label_json": bare})
    told = validate_labels(rows.select(F.col("_group").alias("group_"), "batch", "path", "kind", "number", F.col("_item.place").alias("place"), F.col("_item.key").alias("key"), F.col("_item.snippet").alias("snippet"), "label_json"))
    return told.drop("label_json", "cleared", "snippet")


def label_batches(snippets: DataFrame, call: Labeller, work: Workspace, key: str, snippet: str, group: str | None = None, size: int = BATCH, header: str = HEADER) -> tuple[DataFrame, DataFrame]:
    """(group, batch, key, split_path, label, reason of each snippet: either label or reason is null; the record of each request)."""
    asked, more, k, records, results = requests(snippets, work, key, snippet, group, size), True, 0, [], []
    while more:
        # What is made of the answers, here and in the next round, is made anew from them; their texts are written once.
        judged = _judged(work.save(_answered(asked, call, header), f"answers{k}")).drop("_value")
        labels = work.save(_labels(judged), f"labels{k}")
        records.append(_records(judged))
        own = lambda rows, reason: rows.select(F.col("_group").alias("group"), "batch", "kind", _root(F.col("path")).alias("split_path"), F.inline("items"), reason.alias("reason"))
        results.append(labels.select(F.col("group_").alias("group"), "batch", "kind", _root(F.col("path")).alias("split_path"), "place", "key", "label", "reason"))
        # A schema retry that failed leaves what was there before.
        ended = own(judged.where("todo = 'end' AND kind <> 'schema'"), F.col("problem")).drop("snippet").withColumn("label", F.lit(None).cast(labels.schema["label"].dataType))
        results.append(ended.select(*results[-1].columns))

        again = judged.where("todo = 'reask'").select("_group", "batch", F.concat("path", F.lit(".reask1")).alias("path"), F.lit("reask").alias("kind"), "items", F.lit(REASK).alias("complaint"))
        half = F.floor(F.col("_n") / 2).cast("int")
        halves = F.array(F.struct(F.lit(".L").alias("side"), F.slice("items", F.lit(1), half).alias("part")), F.struct(F.lit(".R").alias("side"), F.slice("items", half + 1, F.col("_n")).alias("part")))
        split = judged.where("todo = 'split'").select("_group", "batch", _root(F.col("path")).alias("path"), F.inline(halves))
        split = split.select("_group", "batch", F.concat("path", "side").alias("path"), F.lit("ask").alias("kind"), F.col("part").alias("items"), F.lit(None).cast("string").alias("complaint"))
        wrong = labels.where("reason IS NOT NULL AND kind <> 'schema'").groupBy("group_", "batch", "path").agg(F.array_sort(F.collect_list(F.struct("number", F.concat(F.lit("snippet "), F.col("number").cast("string"), F.lit(": "), F.col("reason")).alias("said")))).alias("w"))
        said = F.concat(F.lit("\nYour previous reply violated the schema ("), F.array_join(F.transform(F.slice("w", 1, 10), lambda x: x["said"]), "; "), F.lit(")."))
        wrong = wrong.select(F.col("group_").alias("_g"), F.col("batch").alias("_b"), F.col("path").alias("_p"), said.alias("complaint"))
        retry = judged.drop("complaint").join(wrong, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("batch") == F.col("_b")) & (F.col("path") == F.col("_p")))
        retry = retry.select("_group", "batch", F.concat("path", F.lit(".schema-retry")).alias("path"), F.lit("schema").alias("kind"), "items", "complaint")
        k += 1
        asked = again.unionByName(split).unionByName(retry)
        more = asked.limit(1).count()
    whole = reduce(DataFrame.unionByName, results)
    # Of a snippet's rows a valid one counts, else what the first request said.
    best = F.min_by(F.struct("split_path", "label", "reason"), F.struct(F.col("label").isNull(), F.col("kind") == "schema"))
    told = whole.groupBy("group", "batch", "place", "key").agg(best.alias("r"))
    return told.select("group", "batch", "key", "r.split_path", "r.label", "r.reason"), reduce(DataFrame.unionByName, records)
