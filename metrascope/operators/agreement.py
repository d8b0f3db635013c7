"""Stratified samples, agreement of reviewers, calibration against a machine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import kappa, rate_columns, ratio, wilson_bound
from ..workspace import Workspace
from .numbering import numbered


def seeded(seed: str | int, *keys: str) -> Column:
    """A text whose order is a shuffle that SQL engines can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def stratified_sample(rows: DataFrame, stratum: str, key: str, sizes: dict[str, int], seed: str | int) -> DataFrame:
    """Exactly ``sizes[stratum]`` rows of each stratum (all, if fewer), with frame size, n and probability of inclusion."""
    wanted = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(n))])
    frame = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("frame_n")).withColumn("n", F.least(F.coalesce(F.try_element_at(wanted, F.col(stratum)), F.lit(0)), "frame_n").cast("long"))
    # The first rows of a stratum are found without its size; the frame, one row a stratum, then cuts them.
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(seeded(seed, key), key))
    chosen = rows.withColumn("_k", rank).where(F.col("_k") <= max(sizes.values(), default=0))
    held = chosen.join(frame, stratum).where(F.col("_k") <= F.col("n")).drop("_k")
    return held.withColumn("inclusion_p", ratio(F.col("n"), F.col("frame_n")))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agree, kappa) of pairs of verdicts, from the counts of each combination."""
    cells = pairs.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("m"))
    n = cells.agg(F.sum("m").alias("n"), F.sum(F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col("m")).otherwise(0)).alias("same"))
    left = cells.groupBy("_a").agg(F.sum("m").alias("x"))
    right = cells.groupBy("_b").agg(F.sum("m").alias("y"))
    chance = left.join(right, F.col("_a").eqNullSafe(F.col("_b"))).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("cross"))
    both = n.withColumn("cross", F.lit(None).cast("double")).unionByName(chance, allowMissingColumns=True)
    met = both.agg(F.max("n").alias("n"), F.max("same").alias("same"), F.max("cross").alias("cross"))
    agree = ratio(F.col("same"), F.col("n"))
    expected = F.coalesce(F.col("cross"), F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return met.select(F.coalesce("n", F.lit(0)).alias("n"), agree.alias("agree"), kappa(agree, expected).alias("kappa"))


def first_two(verdicts: DataFrame, key: str, reviewer: str, at: str, value: str) -> DataFrame:
    """(key, a, b): the first two verdicts on each item by time."""
    k = F.row_number().over(W.partitionBy(key).orderBy(at, reviewer))
    told = verdicts.withColumn("_k", k).where("_k <= 2").groupBy(key)
    return told.agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("a"), F.max(F.when(F.col("_k") == 2, F.col(value))).alias("b")).where("b IS NOT NULL")


def calibration(rows: DataFrame, human: Column, machine: Column) -> DataFrame:
    """Precision, recall and concordance of a machine against a human, with Wilson bounds of the first."""
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(machine).alias("shown"), F.count_if(machine & human).alias("confirmed"), F.count_if(human).alias("human_positive"), F.count_if(human == machine).alias("concordant"))
    return told.select(
        "n", "shown", "confirmed", ratio(F.col("confirmed"), F.col("shown")).alias("precision"),
        wilson_bound(F.col("confirmed"), F.col("shown"), -1).alias("precision_lo"), wilson_bound(F.col("confirmed"), F.col("shown"), 1).alias("precision_hi"),
        ratio(F.col("confirmed"), F.col("human_positive")).alias("recall"), ratio(F.col("concordant"), F.col("n")).alias("concordance"))


#: What a reviewer says of a true disclosure, and what counts neither for nor against the machine.
TRUE, NOT_EVALUABLE = "TRUE_DISCLOSURE", ("UNCLEAR", "INSUFFICIENT_EVIDENCE")


def plant(frame: DataFrame, orders: DataFrame, n: int, skip: int, seed: str | int, key: str = "arxiv_id") -> DataFrame:
    """``n`` keys of strata POS and FLAG to show again, none that a reviewer has among the first ``skip`` places.

    ``frame``: key, stratum; ``orders``: reviewer, key, place (from 0).
    """
    seen = orders.where(F.col("place") < skip).select(key).distinct()
    return frame.where(F.col("stratum").isin("POS", "FLAG")).join(seen, key, "left_anti").select(key).orderBy(seeded(f"{seed}-plants", key), key).limit(n)


def reviewer_orders(papers: DataFrame, reviewers: Sequence[str], seed: str | int, work: Workspace, key: str = "arxiv_id") -> DataFrame:
    """(reviewer, key, place from 0): all papers, shuffled anew for each reviewer by the seed and the reviewer's name."""
    rows = papers.select(key).distinct().select(F.explode(F.array(*[F.lit(r) for r in reviewers])).alias("reviewer"), key)
    shuffle = F.md5(F.concat_ws("|", F.concat(F.lit(f"{seed}-"), "reviewer"), F.col(key).cast("string")))
    told = numbered(rows, [shuffle, F.col(key)], work, "orders", ["reviewer"])
    return told.select("reviewer", key, (F.col("number") - 1).alias("place"))


def packets(orders: DataFrame, plants: DataFrame, excerpts: DataFrame, seed: str | int, size: int, key: str = "arxiv_id") -> DataFrame:
    """(reviewer, packet, item from 1, blind_id, key, plant, excerpts) of what each reviewer is given, ``size`` papers a packet.

    ``excerpts``: key, and how many excerpts it has; a plant is shown without
    any, like papers that have none. The blind id tells neither paper nor stratum.
    """
    told = orders.join(plants.select(key).distinct().withColumn("_plant", F.lit(True)), key, "left").join(excerpts.groupBy(key).agg(F.sum("excerpts").alias("_n")), key, "left")
    plant = F.coalesce("_plant", F.lit(False))
    blind = F.left(F.sha2(F.concat_ws("|", F.lit(str(seed)), "reviewer", F.col(key).cast("string")), 256), F.lit(16))
    shown = F.when(plant, 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long")
    return told.select("reviewer", F.floor(F.col("place") / size).alias("packet"), (F.pmod("place", F.lit(size)) + 1).alias("item"), blind.alias("blind_id"), key, plant.alias("plant"), shown.alias("excerpts"))


def stratified_calibration(verdicts: DataFrame, frame: DataFrame, machine: DataFrame, seen: DataFrame, excluded: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """measure, n, k, rate and Wilson bounds of a machine against reviewers, by what papers were shown as.

    ``verdicts``: key, verdict; ``frame``: key, stratum (POS, FLAG, NEG), plant;
    ``machine``: key, polarity; ``seen``: keys that the machine classified;
    ``excluded``: key, reason. Excluded papers and verdicts that say nothing
    count in measures of their own only. Agreement is also told apart by
    whether the machine saw the paper.
    """
    told = verdicts.join(frame, key, "left").join(machine.select(key, "polarity"), key, "left")
    told = told.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left").join(excluded.select(key, "reason").dropDuplicates([key]), key, "left")
    true, use = F.coalesce(F.col("verdict") == TRUE, F.lit(False)), F.coalesce(F.col("polarity") == "author_use", F.lit(False))
    plant, seen_too, silent = F.coalesce("plant", F.lit(False)), F.coalesce("_seen", F.lit(False)), F.coalesce(F.col("verdict").isin(*NOT_EVALUABLE), F.lit(False))
    kept = F.col("reason").isNull()
    counts = kept & ~silent
    stratum = lambda s: counts & F.coalesce(F.col("stratum") == s, F.lit(False))
    measures = {
        "pos_shown": (stratum("POS") & ~plant, true), "pos_plants": (counts & plant & use, true), "flag": (stratum("FLAG") & ~plant, true), "neg": (stratum("NEG"), true),
        "agreement": (counts, true == use), "agreement_seen": (counts & seen_too, true == use), "agreement_unseen": (counts & ~seen_too, true == use),
        "not_evaluable": (kept & silent, F.lit(False)), "excluded": (~kept, F.lit(False)),
    }
    rows = told.agg(F.array(*[F.struct(F.lit(name).alias("measure"), F.count_if(inside).alias("_n"), F.count_if(inside & hit).alias("_k")) for name, (inside, hit) in measures.items()]).alias("m"))
    return rows.select(F.inline("m")).select("measure", *rate_columns(F.col("_k"), F.col("_n")))


def unblinded(answers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Answers (reviewer, blind_id, ...) with the keys of ``mapping`` (reviewer, blind_id, key) behind them; a blind id that is missing on either side is an error."""
    told = answers.withColumn("_answered", F.lit(True)).join(mapping, ["reviewer", "blind_id"], "full_outer")
    problem = F.when(F.col("_answered").isNull(), F.concat(F.lit("no answer to "), F.col("blind_id"))).when(F.col("key").isNull(), F.concat(F.lit("unknown item "), F.col("blind_id")))
    return told.where(F.when(problem.isNull(), True).otherwise(F.raise_error(problem).cast("boolean"))).drop("_answered")


def axis_summary(answers: DataFrame, expected: DataFrame, key: str, axes: list[str]) -> DataFrame:
    """axis, n, k: how many items of all answers agree with what is expected on each axis, and on all (axis ``all``)."""
    want = expected.select(key, *[F.col(c).alias(f"_{c}") for c in axes])
    same = [F.to_json(F.struct(F.col(c).alias("x"))).eqNullSafe(F.to_json(F.struct(F.col(f"_{c}").alias("x")))) for c in axes]
    each = [F.struct(F.lit(c).alias("axis"), s.alias("same")) for c, s in zip(axes, same, strict=True)]
    whole = F.struct(F.lit("all").alias("axis"), reduce(Column.__and__, same).alias("same"))
    told = answers.join(want, key).select(F.inline(F.array(*each, whole)))
    return told.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("k"))


def stability(answers: DataFrame, item: str, axes: list[str], expected: dict[str, str] | None = None) -> DataFrame:
    """Whether all repetitions of an item agree on each axis, and match what is expected of it."""
    told = answers.groupBy(item).agg(*[(F.count_distinct(F.to_json(F.struct(c))) == 1).alias(f"{c}_stable") for c in axes], *[F.bool_and(F.col(c).eqNullSafe(F.col(e))).alias(f"{c}_expected") for c, e in (expected or {}).items()])
    return told.withColumn("all_stable", F.forall(F.array(*[F.col(f"{c}_stable") for c in axes]), lambda x: x))
