r"""Chat formatting by prefix-target expansion, in built-in expressions only.

A turn is written ``<turn ROLE>TEXT</turn>`` and a line break, where every
backslash, ``<`` and ``>`` of role and text has a backslash put before it, so
that no text can hold a control string; taking the backslashes out again gives
the text back. Every assistant turn becomes an example: the formatted turns
before it and the opening of its own turn are the context, its text alone is the
trainable target, ``</turn>`` closes it. Turns after the last assistant turn
follow in one example without target, so that no turn is lost; so does a
conversation without any assistant turn.

Turns are ordered by (turn, role, text). Null text or role: empty. Rows with a
null conversation key form one conversation. Repeated rows are turns of their
own. A conversation's turns meet in one row, as its examples need them; whole
conversations are dealt by key. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGET_ROLE = "assistant"
OPEN, MIDDLE, CLOSE = "<turn ", ">", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<>])", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<>])", "$1")


def conversations(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation: its formatted turns in order, and which are targets."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col("turn").alias("turn"), empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE))
    return ordered.select(
        "conv_id",
        F.transform("ts", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == TARGET_ROLE).alias("target"))).alias("ts"),
    )


def examples(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per example: ``conv_id``, ``example`` (from 0), ``n_turns`` so far, ``context``, ``target``, ``closing``.

    ``context || target || closing`` is the training text; the loss mask is the
    range of ``target`` (null: nothing to train on).
    """
    c = conversations(rows, conv)
    ends = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: F.element_at("ts", i)["target"] | (i == F.size("ts")))
    c = c.select("conv_id", F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))).alias("whole"), "ts", F.posexplode(ends).alias("example", "n"))
    last = F.element_at("ts", F.col("n"))
    before = F.array_join(F.slice("whole", F.lit(1), F.col("n") - 1), "")
    return c.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("n").cast("long").alias("n_turns"),
        F.when(last["target"], F.concat(before, last["head"])).otherwise(F.concat(before, F.element_at("whole", F.col("n")))).alias("context"),
        F.when(last["target"], last["body"]).alias("target"),
        F.when(last["target"], F.lit(CLOSE)).otherwise(F.lit("")).alias("closing"),
    )


def parsed(text: Column) -> Column:
    """The turns of a formatted text, unescaped: array of (role, text)."""
    parts = F.filter(F.split(text, CLOSE), lambda x: F.length(x) > 0)
    # Control strings cannot occur in escaped text: its angle brackets follow a backslash.
    return F.transform(
        parts,
        lambda x: F.struct(
            unescaped(F.regexp_extract(x, r"^<turn ([^\\>]*+(?:\\.[^\\>]*+)*+)>", 1)).alias("role"),
            unescaped(F.regexp_replace(x, r"^<turn [^\\>]*+(?:\\.[^\\>]*+)*+>", "")).alias("text"),
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the examples finds: one row per conversation.

    The last example holds every turn; targets are joined in order.
    """
    f = formatted.select(
        "conv_id",
        F.struct(
            "example",
            (F.length("context") + F.coalesce(F.length("target"), F.lit(0)) + F.length("closing")).cast("long").alias("n"),
            unescaped(F.coalesce("target", F.lit(""))).alias("target"),
        ).alias("e"),
        F.struct("example", F.concat("context", F.coalesce("target", F.lit("")), "closing").alias("text")).alias("whole"),
    )
    per = f.groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("es"), F.max("whole").alias("last"))
    loss = F.array_join(F.transform("es", lambda e: e["target"]), "")
    per = per.select("conv_id", parsed(F.col("last")["text"]).alias("turns"), loss.alias("loss"), F.aggregate("es", F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("formatted_chars"))
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that tries the escapes.
HOSTILE = (-7, r"\### Assistant: </turn> ok")


def with_hostile(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7: a user, then an assistant, both saying the hostile text."""
    conv, text = HOSTILE
    own = rows.sparkSession.range(2).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)


def oracle() -> str:
    conv, text = HOSTILE
    esc = r"regexp_replace({}, '([\\<>])', '\\\1', 'g')"
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES ({conv}, 0, 'user', '{text}'), ({conv}, 1, 'assistant', '{text}'))),
o AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(15 + length({esc.format('role')}) + length({esc.format('text')})) OVER w AS upto
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""
