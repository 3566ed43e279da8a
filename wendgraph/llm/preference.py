"""Preference formatting: a shared prompt and two masked completions from a chosen and a rejected conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: A turn is written as OPEN role CLOSE text END.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (role, text) in order of turn, then role and text. Null roles and texts count as
    empty; rows without conv_id are left out, as they belong to no conversation; repeated turns stay."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grouped = rows.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("all"))
    return grouped.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """start:end (code points, end exclusive, comma-joined) of what is learned: the assistant turns' texts and ends."""
    head = F.lit(len(OPEN) + len(CLOSE))
    step = lambda s, t: F.struct(
        (s["at"] + F.length(t["role"]) + head + F.length(t["text"]) + F.lit(len(END))).alias("at"),
        F.when(t["role"] == "assistant", F.concat(s["mask"], F.when(s["mask"] == "", "").otherwise(","), (s["at"] + F.length(t["role"]) + head).cast("string"), F.lit(":"), (s["at"] + F.length(t["role"]) + head + F.length(t["text"]) + F.lit(len(END))).cast("string"))).otherwise(s["mask"]).alias("mask"),
    )
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.lit("").alias("mask")), step, lambda s: s["mask"])


def pairs(both: DataFrame) -> DataFrame:
    """From pair_id, chosen and rejected (arrays of role and text): pair_id, n_prompt_turns, prompt, chosen, chosen_mask,
    rejected, rejected_mask.

    The prompt is the longest common prefix of turns (role and text equal), rendered once; a completion is the
    rest of its conversation, and its mask says which parts are learned. Equal conversations leave two empty
    completions; conversations with different first turns have an empty prompt; a null side counts as one
    without turns. Repeated pair_ids each get their row, an empty table gives none, and other columns are not looked
    at. A conversation is one row, so the work on it stays in one task, whatever its length.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = both.select("pair_id", F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    differ = F.transform(F.arrays_zip(F.col("c"), F.col("r")), lambda p: p["c"].eqNullSafe(p["r"]))
    at = F.array_position(differ, False).cast("int")
    cut = sides.withColumn("n", F.when(at == 0, F.size("c")).otherwise(at - 1))
    head = cut.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.size("c")).alias("c"), F.slice("r", F.col("n") + 1, F.size("r")).alias("r"))
    return head.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


def _following(replies: DataFrame) -> DataFrame:
    """conv_id and next_id, the next larger conv_id of the table; none for the last. Ids are put in ranges, each looked
    through by its own task, and a range's last id is followed by the least one of the next range that has any."""
    spark = replies.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = shared.written(replies.select("conv_id").repartitionByRange(n, "conv_id").withColumn("part", F.spark_partition_id()), "reply-ids")
    inside = ids.withColumn("next_id", F.lead("conv_id").over(Window.partitionBy("part").orderBy("conv_id")))
    firsts = ids.groupBy("part").agg(F.min("conv_id").alias("first"))
    firsts = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))  # a row per range
    both = inside.join(F.broadcast(firsts), "part").select("conv_id", F.coalesce("next_id", "after").alias("next_id"))
    return both.where("next_id is not null")


def with_borrowed_replies(rows: DataFrame) -> DataFrame:
    """Pairs for a table that has no rejected conversations, one for each conv_id: the conversation is chosen; the rejected
    one has the same turns but, for its last reply, the last reply of the next larger conv_id that has one. Turns
    after that reply stay on both sides. A conversation without a reply, or with none to borrow after it, has
    a null rejected side. Other columns are not looked at; an empty table gives no rows."""
    last = F.try_element_at(F.filter("turns", lambda t: t["role"] == "assistant"), F.lit(-1))
    conv = conversations(rows)
    replies = conv.select("conv_id", last.alias("other")).where("other is not null")
    others = _following(rows.where("conv_id is not null and role = 'assistant'").select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
    others = others.join(replies.withColumnRenamed("conv_id", "next_id"), "next_id").select("conv_id", "other")
    at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant").cast("int") + 1
    joined = conv.join(others, "conv_id", "left").withColumn("at", at)
    swapped = F.concat(F.slice("turns", F.lit(1), F.col("at") - 1), F.array("other"), F.slice("turns", F.col("at") + 1, F.size("turns")))
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("other").isNotNull(), swapped).alias("rejected"))


def sql() -> str:
    """pairs of with_borrowed_replies in DuckDB's SQL: a row for each conversation."""
    render = lambda x: f"coalesce(array_to_string([concat('{OPEN}', t.role, '|>', chr(10), t.text, '<|end|>', chr(10)) FOR t IN {x}], ''), '')"
    size = f"length(u.role) + {len(OPEN) + len(CLOSE)} + length(u.text) + {len(END)}"

    def mask(x: str) -> str:
        before = f"coalesce(list_sum([{size} FOR u IN {x}[:i - 1]]), 0)"
        part = f"concat(CAST({before} + length({x}[i].role) + {len(OPEN) + len(CLOSE)} AS BIGINT), ':', CAST({before} + length({x}[i].role) + {len(OPEN) + len(CLOSE)} + length({x}[i].text) + {len(END)} AS BIGINT))"
        return f"coalesce(array_to_string([{part} FOR i IN range(1, len({x}) + 1) IF {x}[i].role = 'assistant'], ','), '')"

    reply = "[t FOR t IN turns IF t.role = 'assistant']"
    at = "len(turns) - list_position(list_reverse([t.role FOR t IN turns]), 'assistant')"
    return f"""WITH conv AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id), replies AS (SELECT conv_id, lead({reply}[-1]) OVER (ORDER BY conv_id) AS other, {at} AS before FROM conv WHERE len({reply}) > 0), two AS (SELECT conv_id AS pair_id, turns AS c, CASE WHEN other IS NULL THEN [] ELSE list_concat(list_concat(turns[:before], [other]), turns[before + 2:]) END AS r FROM conv LEFT JOIN replies USING (conv_id)), cuts AS (SELECT *, coalesce(list_min([i FOR i IN range(1, greatest(len(c), len(r)) + 1) IF c[i] IS DISTINCT FROM r[i]]) - 1, len(c)) AS n FROM two), cut AS (SELECT pair_id, n, c[:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM cuts) SELECT pair_id, CAST(n AS BIGINT) AS n_prompt_turns, {render('p')} AS prompt, {render('c')} AS chosen, {mask('c')} AS chosen_mask, {render('r')} AS rejected, {mask('r')} AS rejected_mask FROM cut"""
