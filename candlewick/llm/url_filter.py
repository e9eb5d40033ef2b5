"""URL filters: listed rules first, else association rules mined by FP-growth.

Host: what follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end; a null url or one without ``://``
has neither. A listed rule fits its host and all subdomains if the path starts
with the rule's; the longest fitting rule decides.

For the rest, labelled urls become sets of tokens (scheme, host labels, path
parts, query names) with a mark for bad ones. Tokens that stand on the very same
urls are one item, so that a repeated url is mined as few items and not as all
subsets of its tokens; a token that all of them hold tells nothing and goes.
FP-growth finds the sets of items that at least ``MIN_COUNT`` of the urls hold; a
rule "items, so bad" stays if its confidence, less two standard errors, reaches
``MIN_CONFIDENCE`` and no part of its items does as well. Every url is looked up
in an inverted index from the tokens of each rule's rarest item, and matches if it
holds a token of each item, as each of them says the same; then it is blocked.

Without labelled urls, or without rules, the rest is allowed. Rows are judged by
their url, so repeated rows get one verdict. Only built-in expressions and
Spark's own FP-growth run; only the named columns are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, host, path) of the listed rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_COUNT = 12
MIN_CONFIDENCE = 0.5
BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none fits."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens of a url, each with the part that it stands in."""
    u = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)

    def split(part: Column, mark: str, pattern: str) -> Column:
        return F.transform(F.filter(F.split(part, pattern), lambda x: F.length(x) > 0), lambda x: F.concat(F.lit(mark), x))

    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: F.length(x) > 0), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.filter(F.array(F.concat(F.lit("s:"), F.regexp_extract(u, r"(?s)^([^/?#]*?)://", 1))), lambda x: F.length(x) > 2)
    return F.array_distinct(F.concat(scheme, split(host_of(u), "h:", r"[^a-z0-9]+"), split(path_of(u), "p:", r"[^a-z0-9]+"), names))


def mined(labelled: DataFrame, url: str = "url", bad: str = "bad", min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from labelled urls: ``rule_id, items, anchors, confidence, support_count``.

    ``items``: for each item its tokens; ``anchors``: the tokens of the rarest one.
    """
    spark = labelled.sparkSession
    rows = written(labelled.select(F.monotonically_increasing_id().alias("id"), tokens(F.col(url)).alias("tokens"), F.col(bad).alias("bad")).where("bad IS NOT NULL"), "labelled")
    n = rows.count()
    if not n:
        return spark.range(0).selectExpr("id AS rule_id", "array(array('')) AS items", "array('') AS anchors", "1D AS confidence", "1D AS support_count")
    spread = rows.select("id", F.explode("tokens").alias("token"), "bad")
    # A token of a rule stands on at least ``min_count`` bad urls, as the whole rule does. Two hashes tell the urls of a token.
    per = spread.groupBy("token").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("b"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y")
    )
    per = per.where((F.col("b") >= min_count) & (F.col("n") < n)).groupBy("n", "x", "y")
    # Tokens of one item stand together in a url, which bounds their list.
    items = written(per.agg(F.array_sort(F.collect_list("token")).alias("alike")).select("n", F.element_at("alike", 1).alias("token"), "alike"), "items")
    sets = spread.join(items.select("token"), "token").groupBy("id").agg(F.collect_list("token").alias("t")).join(rows.select("id", "bad"), "id")
    sets = sets.select(F.when(F.col("bad"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items"))
    sets = written(sets, "sets")
    n = max(sets.count(), 1)  # what FP-growth's shares refer to
    support = min(1.0, (min_count - 0.5) / n)  # rounded up to min_count, at every size
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(sets).associationRules
    sure = F.col("confidence") - 2 * F.sqrt(F.col("confidence") * (1 - F.col("confidence")) * F.col("confidence") / (F.col("support") * n))
    rules = rules.where(F.col("consequent") == F.array(F.lit(BAD))).where(sure >= min_confidence)
    rules = written(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * n).alias("support_count")), "rules")
    # A rule goes if a shorter one, a part of it, is as sure: parts share their first token with some token of it.
    part = rules.select(F.col("tokens").alias("p"), F.col("confidence").alias("c"), F.element_at("tokens", 1).alias("first"))
    spread = rules.select("tokens", "confidence", F.explode("tokens").alias("first")).join(part, "first")
    covered = spread.where((F.size("p") < F.size("tokens")) & (F.size(F.array_except("p", "tokens")) == 0) & (F.col("c") >= F.col("confidence"))).select("tokens")
    rules = rules.join(covered.distinct(), "tokens", "left_anti").withColumn("rule_id", F.xxhash64("tokens"))
    named = rules.select("rule_id", F.explode("tokens").alias("token")).join(items, "token")
    named = named.groupBy("rule_id").agg(F.array_sort(F.collect_list("alike")).alias("items"), F.min(F.struct("n", "token", "alike")).alias("a"))
    return written(rules.join(named, "rule_id").select("rule_id", "items", F.col("a.alike").alias("anchors"), "confidence", "support_count"), "index")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``u`` (distinct urls of ``urls``) that at least one rule matches.

    The index has the size that the planner reads from its files: it is broadcast
    only if that is small, else shuffled by token, where hot tokens may be split.
    """
    posted = urls.select("u", tokens(F.col("u")).alias("own")).select("u", "own", F.explode("own").alias("anchor"))
    index = rules.select(F.explode("anchors").alias("anchor"), "items")
    hits = posted.join(index, "anchor").where(F.forall("items", lambda alike: F.arrays_overlap(alike, "own")))
    return hits.select("u").distinct()


def judged(pages: DataFrame, labelled: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``key, host, path, rule, verdict`` of each row; ``labelled`` has columns ``url`` and ``bad``."""
    p = pages.select(F.col(key).alias("key"), F.col(url).alias("u"))
    p = p.select("key", "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    p = p.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    found = mined(labelled)
    if found.isEmpty():
        blocked = F.lit(False)
    else:
        hits = matched(p.where("listed IS NULL AND u IS NOT NULL").select("u").distinct(), found).select(F.col("u").alias("hit"))
        p = p.join(hits, F.col("u") == F.col("hit"), "left")
        blocked = F.col("hit").isNotNull()
    verdict = F.coalesce(F.col("listed.verdict"), F.when(blocked, "block").otherwise("allow"))
    return p.select(F.col("key").alias(key), "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"))


def oracle(rules=RULES) -> str:
    """DuckDB SQL of ``judged`` over ``pages`` where no rule is mined, as in the given tables: their labels do not follow the urls."""
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH r AS (SELECT * FROM (VALUES {rows}) AS t(verdict, h, p)),
u AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
b AS (
  SELECT rid, max_by(h || p, length(h) + length(p)) AS rule, max_by(verdict, length(h) + length(p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN b USING (rid)"""
