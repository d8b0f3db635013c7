"""What a report or a frozen release needs: runs that belong together, complete provenance, counts and hashes."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate_columns, ratio
from ..operators.labels import roll_up
from ..operators.selection import coverage, membership_hash, version_stratum

#: Ended runs, and a commit that can be found again.
ENDED, COMMIT = ("complete", "partial"), r"[0-9a-f]{7,40}"


def run_problems(scans: DataFrame, labelled: DataFrame, items: DataFrame, scan_run: str, label_run: str, freeze: bool = False) -> list[str]:
    """Why two runs cannot carry a report (or, with ``freeze``, a release); empty if they can."""
    own = scans.where(F.col("run_id") == scan_run).limit(1).collect()
    told = labelled.where(F.col("run_id") == label_run).limit(1).collect()
    if not own or not told:
        return [f"no scan run {scan_run}"] * (not own) + [f"no label run {label_run}"] * (not told)
    scan, label = own[0], told[0]
    consumed = json.loads(label.scan_runs_json or "[]")
    checks = [
        (items.where(F.col("run_id") == scan_run).limit(1).count() > 0, "the scan run has no items"),
        (scan.stage == "tex", "the scan run has no full text"),
        (not consumed or scan_run in consumed, "the runs do not belong together"),
        (label.status != "complete_scoped" and not json.loads(label.params_json or "{}").get("scope"), "the label run is scoped"),
        (scan.status in ENDED, f"the scan run has status {scan.status}"),
        (label.status in ENDED, f"the label run has status {label.status}"),
    ]
    if freeze:
        checks += [
            (label.status == "complete", f"a release needs a complete label run, not status {label.status}"),
            ("(unpinned)" not in (label.model or ""), "the model is not pinned"),
            (bool(consumed), "the label run does not say what it consumed"),
            *[(bool(re.fullmatch(COMMIT, run.code_commit or "")), f"the {name} run has no clean commit") for name, run in (("scan", scan), ("label", label))],
            ((label.backend or "").startswith("api:"), f"the backend is {label.backend}"),
            (bool(label.isolate), "the label run was not isolated"),
        ]
    return [why for holds, why in checks if not holds]


def paper_table(papers: DataFrame, scan_items: DataFrame, files: DataFrame, hits: DataFrame, label_items: DataFrame, start: str, end: str, category: str = "math", **gates: bool) -> DataFrame:
    """One row per paper of the cohort: month, state, stratum, flagged, pending, failed, polarity, positive, unverified.

    ``hits`` and ``label_items`` are those of the selected runs.
    """
    frame = papers.where(F.col("primary_category").startswith(category) & F.col("created").between(start, end)).select("arxiv_id", F.date_format("created", "yyyy-MM").alias("month"))
    states = coverage(frame, scan_items, files)
    version = scan_items.groupBy("arxiv_id").agg(F.min("version").alias("version"), F.min("version_basis").alias("basis"))
    flagged = hits.where(F.col("tier").isin("llm", "generic") & (F.col("rule_class") != "known_fp")).select("arxiv_id", F.lit(True).alias("flagged")).distinct()
    seen = label_items.groupBy("arxiv_id").agg(F.lit(True).alias("seen"), F.bool_or(F.col("status") == "ok").alias("any_ok"))
    rolled = roll_up(label_items.where("status = 'ok'"), **gates).select("arxiv_id", "polarity", "ungated")
    rows = states.join(version, "arxiv_id", "left").join(flagged, "arxiv_id", "left").join(seen, "arxiv_id", "left").join(rolled, "arxiv_id", "left")
    scanned, is_flagged = F.col("state") == "scanned", F.coalesce("flagged", F.lit(False))
    return rows.select(
        "arxiv_id", "month", "state", version_stratum(F.col("version"), F.col("basis")).alias("stratum"), (scanned & is_flagged).alias("flagged"),
        (scanned & is_flagged & F.col("seen").isNull()).alias("pending"), (scanned & ~F.coalesce("any_ok", F.lit(True))).alias("failed"), "polarity", (scanned & F.coalesce(F.col("polarity") == "author_use", F.lit(False))).alias("positive"),
        (scanned & F.coalesce("ungated", F.lit(False))).alias("unverified"))


def prevalence(table: DataFrame, *by: str) -> DataFrame:
    """n scanned, positive, rate with bounds, flagged and pending by the columns given."""
    told = table.where("state = 'scanned'").groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if("positive").alias("_k"), F.count_if("flagged").alias("flagged"), F.count_if("pending").alias("pending"))
    return told.select(*by, *rate_columns(F.col("_k"), F.col("_n")), "flagged", "pending")


def unresolved(table: DataFrame) -> DataFrame:
    """Papers without an outcome, by the first reason that applies, and the extreme rates over the whole frame.

    The extremes take all unresolved papers for negative, then for positive;
    they bound what is missing, not the error of labels.
    """
    why = F.when(F.col("state") != "scanned", "not_scanned").when(F.col("pending"), "pending").when(F.col("failed"), "failed").when(F.col("unverified"), "unverified")
    told = table.withColumn("_why", why)
    positive = F.count_if(F.col("positive") & F.col("_why").isNull())
    n, open_ = F.count(F.lit(1)), F.count("_why")
    reasons = [F.count_if(F.col("_why") == r).alias(r) for r in ("not_scanned", "pending", "failed", "unverified")]
    return told.agg(n.alias("frame"), positive.alias("positive"), open_.alias("unresolved"), *reasons, F.round(ratio(positive, n), 5).alias("lowest"), F.round(ratio(positive + open_, n), 5).alias("highest"))


def report(table: DataFrame, rolled: DataFrame) -> DataFrame:
    """(section, name, n) of a report: states, months, strata and polarities of the frame, then categories, impacts and locations of positive papers.

    ``rolled``: papers as ``roll_up`` gives them. One row per cell, for any presentation.
    """
    of = lambda df, section, value: df.groupBy(F.lit(section).alias("section"), value.cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    scanned = table.where("state = 'scanned'")
    use = rolled.join(scanned.where("positive").select("arxiv_id"), "arxiv_id", "left_semi")
    listed = lambda c: F.explode(F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("unknown"))))
    parts = [of(table, "state", F.col("state")), of(table, "month", F.col("month")), of(scanned, "stratum", F.col("stratum")), of(scanned, "polarity", F.coalesce("polarity", F.lit("none")))]
    parts += [of(use.select(listed(c).alias("v")), section, F.col("v")) for section, c in (("category", "categories"), ("location", "locations"), ("tool", "tools"))]
    parts.append(of(use, "impact", F.coalesce("impact", F.lit("unknown"))))
    return reduce(DataFrame.unionByName, parts)


def release_counts(table: DataFrame, scan_items: DataFrame) -> DataFrame:
    """The single row of a release: scanned, positive, and the hash of its members."""
    members = table.where("state = 'scanned'").join(scan_items.select("arxiv_id", "version"), "arxiv_id")
    held = membership_hash(members, F.col("arxiv_id"), F.col("version"))
    both = held.unionByName(table.agg(F.count_if("positive").alias("positive"), F.count_if("pending").alias("pending")), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
