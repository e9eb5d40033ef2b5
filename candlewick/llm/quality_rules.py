"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Words are maximal runs of characters other than space and ``\\t\\n\\v\\f\\r``; null
and empty texts have none and fail the base rule. Long texts are read whole, and
no threshold bounds the length from above: ratios judge a long text as any other.
Distinct words are held against the root of the number of words, as their share
falls with length in any prose. Repeated windows are found by sorting hashes of
windows with their places and comparing the words of neighbours with equal
hashes; a text where hashes meet by chance is counted by the windows themselves.
Repeated rows are judged one by one, so each gets the same verdict. Only the key
and text columns are read; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with "
    "der die und in den von zu das "
    "de la le et les des en un "
    "el que y los se del las por"
).split()


@dataclass(frozen=True)
class Threshold:
    """Rejects a text whose ``metric`` lies below ``low`` or above ``high``."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Metrics are ratios of the counts below; see ``RATIOS``.
THRESHOLDS = (
    Threshold("n_words", low=50),
    Threshold("mean_word_chars", low=2.0, high=14.0),
    Threshold("symbols_per_word", high=0.1),
    Threshold("shouts_per_word", high=0.2),
    Threshold("stop_word_share", low=0.01),
    Threshold("dup_line_share", high=0.6),
    Threshold("repeat_word_share", high=0.5),
    Threshold("distinct_words_by_root", low=1.0),
    Threshold("ellipsis_line_share", high=0.3),
    Threshold("bullet_line_share", high=0.9),
)

#: SQL of each ratio over the counted columns; none divides by zero.
RATIOS = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "shouts_per_word": "n_shouts / greatest(n_words, 1)",
    "stop_word_share": "n_stop_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words_by_root": "n_distinct_words / sqrt(greatest(n_words, 1))",
    "ellipsis_line_share": "n_ellipsis_lines / greatest(n_lines, 1)",
    "bullet_line_share": "n_bullet_lines / greatest(n_lines, 1)",
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_ellipsis_lines", "n_bullet_lines")


def rejection(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> str:
    """The threshold table as one SQL condition that holds for rejected texts."""
    parts = [f"({RATIOS[t.metric]}) < {t.low}" for t in thresholds if t.low is not None]
    parts += [f"({RATIOS[t.metric]}) > {t.high}" for t in thresholds if t.high is not None]
    return " OR ".join(f"({p})" for p in parts) or "false"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(places: Column) -> Column:
    """How many words lie in the 3-word windows that begin at the places."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))


def _covered_by_words(words: Column) -> Column:
    """Words in windows that occur at least twice, by sorting the windows themselves."""
    window = lambda x, i: F.struct(F.concat_ws(" ", x, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.cast("long").alias("i"))
    first = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    alike = lambda s: F.filter(s, lambda x, k: F.coalesce(x["w"] == F.get(s, k + 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, k - 1)["w"], F.lit(False)))
    return _covered(_let(F.sort_array(F.transform(first, window)), lambda s: F.transform(alike(s), lambda x: x["i"])))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the counts of each text, as one chain of projections."""
    d = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    d = d.select(
        "__key",
        F.array_remove(F.split(F.regexp_replace("__t", SPACE, " "), " "), "").alias("__w"),
        F.regexp_count("__t", F.lit(f"[{re.escape(SYMBOLS)}]")).cast("long").alias("n_symbols"),
        (F.length("__t") - F.length(F.replace("__t", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
    )
    # Low bits of a window's number are its place, as many as the number of words has; the others are its hash.
    d = d.select("*", F.transform("__w", lambda x: F.xxhash64(x)).alias("__h"), F.length(F.bin(F.size("__w"))).alias("__b"))
    hashed = lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get("__h", i + 1), F.get("__h", i + 2)), F.col("__b")).bitwiseOR(i.cast("long"))
    first = F.slice("__h", F.lit(1), F.greatest(F.size("__h") - 2, F.lit(0)))
    d = d.select("*", F.sort_array(F.transform(first, hashed)).alias("__s"))
    same = lambda x, y: F.coalesce(F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("__b")) == 0, F.lit(False))
    d = d.select("*", F.filter("__s", lambda x, k: same(x, F.get("__s", k + 1)) | same(x, F.get("__s", k - 1))).alias("__q"))
    place = lambda x: (x - F.call_function("shiftleft", F.call_function("shiftright", x, F.col("__b")), F.col("__b"))).cast("int")
    differ = lambda a, b: F.exists(F.array(*map(F.lit, range(3))), lambda k: F.get("__w", a + k) != F.get("__w", b + k))
    clash = F.exists(F.transform("__q", lambda x, k: same(x, F.get("__q", k + 1)) & differ(place(x), place(F.coalesce(F.get("__q", k + 1), x)))), lambda x: x)
    repeated = F.when(F.size("__q") == 0, 0).when(clash, _covered_by_words(F.col("__w"))).otherwise(_covered(F.transform("__q", place)))
    counts = F.struct(
        F.col("__key").alias(key),
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_shouts",
        F.size(F.filter("__w", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct_words"),
        F.size(F.filter("__l", lambda x: F.rtrim(x, F.lit(" \t\f\r")).endswith("...") | F.rtrim(x, F.lit(" \t\f\r")).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("__l", lambda x: x.rlike(r"^\s*[•‣*-]\s"))).cast("long").alias("n_bullet_lines"),
    )
    # A generator, as a filter on the counts must not be pushed below the projections: it would compute each anew wherever it is named.
    return d.select(F.explode(F.array(counts)).alias("__c")).select("__c.*")


BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """Counts and verdict of each row: ``base_failed`` and ``kept``. Null texts count as empty."""
    return (
        counted(docs, key, text)
        .withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("kept", F.expr(f"NOT ({BASE_FAILED}) AND NOT ({rejection(thresholds)})"))
    )


def kept_rows(docs: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns unchanged."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    held = row.select("__row", F.col(f"__row.`{text}`").alias("__text"))
    verdict = judged(held, "__row", "__text", thresholds).where("kept")
    return verdict.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])


def oracle(source: str, columns: str, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> str:
    """DuckDB SQL of ``judged`` over a table with ``doc_id`` and ``text``."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    space = r"[^\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {source}),
w AS (
  SELECT *, regexp_extract_all(t, '{space}+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS ls
  FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win JOIN dup USING (rid, g)) GROUP BY rid),
c AS (
  SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(translate(t, '!', '')) AS BIGINT) AS n_shouts,
    CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct_words,
    CAST(len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\f\r]*$'))) AS BIGINT) AS n_ellipsis_lines,
    CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[•‣*-]\s'))) AS BIGINT) AS n_bullet_lines
  FROM w LEFT JOIN cov ON w.rid = cov.rid),
j AS (SELECT *, {BASE_FAILED} AS base_failed, NOT ({BASE_FAILED}) AND NOT ({rejection(thresholds)}) AS kept FROM c)
SELECT {columns} FROM j"""
