"""Preference pairs: the shared opening rendered once as prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import col
from regionflow.operators.skew import stored

TURNS = "array<struct<role:string,text:string>>"


def conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turns): each conversation's (role, text) in turn order, ties by role and text.

    Rows without a conversation id belong to none and are left out. Repeated
    rows stay repeated turns; null roles and texts stay null.
    """
    return (
        turns.filter(col(conv_id).isNotNull())
        .select(
            col(conv_id).alias("conv_id"),
            F.struct(
                col(turn).alias("turn"), col(role).cast("string").alias("role"), col(text).cast("string").alias("text")
            ).alias("t"),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    )


def preference_pairs(convs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected) out of (conv_id, turns), one row per conversation or fewer.

    Conversations with an equal first turn answer the same request: the one with
    the smallest id is chosen against each of the others. A conversation alone
    with its first turn is chosen against itself with a stale last answer, that
    is, its last assistant turn replaced by its first one; without an assistant
    turn it makes no pair. Sides that are equal turn by turn, which leave nothing to
    prefer, make no pair. Openings are compared by a SHA-256 of role and text.
    """
    convs = stored(convs, "conversations")
    first = F.get("turns", F.lit(0))
    told = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))  # noqa: E731  null is not the empty text
    opening = F.sha2(F.concat_ws("\n", told(first["role"]), told(first["text"])), 256)
    heads = convs.select(opening.alias("opening"), "conv_id")
    groups = stored(heads.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count("*").alias("n")), "openings")

    shared = heads.join(groups.filter("n > 1"), "opening").filter("conv_id != chosen_id")
    chosen = (
        groups.filter("n > 1")
        .join(convs, F.col("chosen_id") == F.col("conv_id"))
        .select("opening", "chosen_id", F.col("turns").alias("chosen"))
    )
    rival = shared.select("opening", F.col("conv_id").alias("rejected_id")).join(
        convs.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected")), "rejected_id"
    )
    against_others = rival.join(chosen, "opening").select("chosen_id", "rejected_id", "chosen", "rejected")

    answers = F.filter(
        F.transform("turns", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"))),
        lambda t: t["role"] == "assistant",
    )
    stale = F.transform(
        "turns",
        lambda t, i: F.when(
            i == F.element_at("answers", -1)["i"],
            F.struct(t["role"].alias("role"), F.element_at("answers", 1)["text"].alias("text")),
        ).otherwise(t),
    )
    against_itself = (
        groups.filter("n = 1")
        .join(convs, F.col("chosen_id") == F.col("conv_id"))
        .withColumn("answers", answers)
        .filter(F.size("answers") > 0)
        .select("chosen_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("chosen"), stale.alias("rejected"))
    )
    both = against_others.unionByName(against_itself)
    return both.filter(~F.col("chosen").eqNullSafe(F.col("rejected")))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    """`<|role|>`, line feed, text, `<|end|>`, line feed for each turn. A null role is `unknown`, a null text empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def trained_spans(turns: Column) -> Column:
    """`start:length` in characters of the rendered turns, comma-separated: the assistant's texts with their end mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + F.length(_head(t))
        span = F.concat_ws(":", body.cast("string"), F.length(_body(t)).cast("string"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((body + F.length(_body(t))).alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda acc: acc["spans"]), ",")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """`pairs` without its two conversations, with the longest common turn prefix
    rendered once as `prompt`, its length `n_prompt`, and for either side the
    completion and the spans of it that are trained on.

    Turns are equal if role and text are, null being equal to null. Equal
    conversations give empty completions; a null conversation counts as empty.
    """
    none = F.array().cast(TURNS)
    sides = pairs.withColumns({c: F.coalesce(col(c).cast(TURNS), none) for c in (chosen, rejected)})
    same = F.zip_with(col(chosen), col(rejected), lambda a, b: a.eqNullSafe(b))
    parts = sides.withColumn("_differ", F.array_position(same, False).cast("int")).withColumn(
        "n_prompt", F.when(F.col("_differ") == 0, F.size(col(chosen))).otherwise(F.col("_differ") - 1)
    )
    rest = {c: F.slice(col(c), F.col("n_prompt") + 1, F.greatest(F.size(col(c)) - F.col("n_prompt"), F.lit(0))) for c in (chosen, rejected)}
    return parts.select(
        *[col(c) for c in pairs.columns if c not in (chosen, rejected)],
        "n_prompt",
        render(F.slice(col(chosen), F.lit(1), F.col("n_prompt"))).alias("prompt"),
        render(rest[chosen]).alias("chosen_completion"),
        trained_spans(rest[chosen]).alias("chosen_spans"),
        render(rest[rejected]).alias("rejected_completion"),
        trained_spans(rest[rejected]).alias("rejected_spans"),
    )
