"""URL filter lists by hashed host-suffix and path-prefix expressions.

Each url becomes the expressions that a rule could have: a suffix of its host
at a label boundary and a prefix of its path. They meet the rules in an
equi-join on 32 bits of a SHA-256, which the full digest then confirms; of the
rules that fit, the longest decides. Everything is Spark expressions.

A list of at most ``BROADCAST`` rules meets the expressions by a broadcast. A
longer one meets them in a shuffle, in which a rule that a third of all urls
fit (a whole top-level domain, say) is dealt to several tasks.

Defined results: a null url, or one without ``://``, has an empty host and
path and fits no rule; rows with equal ids are judged one by one; of a very long url
all host suffixes, and path prefixes of the lengths that rules have, are
expressions; extra columns are ignored; an empty table gives an empty result.
Ties: the longest rule decides, by host and then by path; where an allow and a
block rule have the same host and path, the block wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups

#: The rules of the registered query: (host, path, action).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

#: Rules that are broadcast, at most: some 100 bytes each.
BROADCAST = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    bare = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.translate(F.substring_index(bare, "/", 1), _UPPER, _LOWER)
    path = F.substring(bare, F.length(F.substring_index(bare, "/", 1)) + 1, F.length(bare))
    return host, path


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, action) rows as a DataFrame built from literals."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("host"), F.lit("").alias("path"), F.lit("").alias("action"))
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules])
    return spark.range(1).select(F.inline(rows))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """``keep`` columns, host, path, rule (null if none fits) and verdict for each row.

    ``rules``: host, path, action (allow or block). The lengths that hosts and
    paths of rules have bound what a url expands into; they are read first, and
    are at most as many as a rule has characters.
    """
    shape = rules.agg(
        F.sort_array(F.collect_set(F.length("host"))).alias("hosts"),
        F.sort_array(F.collect_set(F.length("path"))).alias("paths"),
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels"), F.count(F.lit(1)).alias("n"),
    ).first()
    listed = rules.groupBy(_digest(F.col("host"), F.col("path")).alias("_rule_digest")).agg(F.max((F.col("action") == "block").cast("int")).alias("_block"))
    listed = listed.withColumn("_rule_key", F.substring("_rule_digest", 1, 8))
    lengths = lambda xs: F.array(*[F.lit(int(x)) for x in xs]).cast("array<int>")

    host, path = host_and_path(F.col(url))
    rows = urls.select(*[F.col(k) for k in keep], host.alias("_host"), path.alias("_path"), F.monotonically_increasing_id().alias("_row"))
    labels = F.split("_host", r"\.")
    most = max(1, shape.labels)
    last = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - most + 1), F.lit(most))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
    suffixes = F.filter(suffixes, lambda s: F.array_contains(lengths(shape.hosts), F.length(s)))
    prefixes = F.transform(F.filter(lengths(shape.paths), lambda n: n <= F.length("_path")), lambda n: F.left(F.col("_path"), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))
    asked = rows.withColumn("_e", F.explode_outer(pairs)).withColumn("_digest", _digest(F.col("_e.host"), F.col("_e.path")))
    asked = asked.withColumn("_key", F.substring("_digest", 1, 8))
    if shape.n <= BROADCAST:
        met = asked.join(F.broadcast(listed), (F.col("_key") == F.col("_rule_key")) & (F.col("_digest") == F.col("_rule_digest")), "left")
    else:
        # Short keys first, with the digests of all their rules (hardly ever more than one), then the digest confirms.
        by_key = listed.groupBy(F.col("_rule_key").alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("_rule_digest", "_block"))).alias("_rules"))
        sizes = asked.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"))
        met = join_groups(asked, by_key.join(sizes, "_key"), "_key", "_size", ["_rules"], F.col("_row"))
        met = met.withColumn("_block", F.try_element_at("_rules", F.col("_digest")))

    # Of one url, the length of the rule and of its host name the rule: the winner needs no second join.
    size = F.length("_e.host") + F.length("_e.path")
    order = F.when(F.col("_block").isNotNull(), size.cast("long") * (1 << 32) + F.length("_e.host") * 2 + F.col("_block"))
    best = met.groupBy("_row", *keep, "_host", "_path").agg(F.max(order).alias("_best"))
    total, rest = F.floor(F.col("_best") / (1 << 32)).cast("int"), F.col("_best") % (1 << 32)
    host_size = F.floor(rest / 2).cast("int")
    rule = F.concat(F.right(F.col("_host"), host_size), F.left(F.col("_path"), total - host_size))
    verdict = F.when(F.col("_best").isNull(), default).when(rest % 2 == 1, "block").otherwise("allow")
    return best.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), F.when(F.col("_best").isNotNull(), rule).alias("rule"), verdict.alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, RULES))


OP4_SQL = """
WITH r(rh, rp, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT page_id, row_number() OVER () AS n,
               CASE WHEN contains(url, '://') THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^?#]*') ELSE '' END AS bare FROM pages),
u AS (SELECT page_id, n, translate(regexp_extract(bare, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             bare[length(regexp_extract(bare, '^[^/]*')) + 1:] AS path FROM cut),
m AS (SELECT u.*, rh || rp AS rule, action,
             row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
      FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
