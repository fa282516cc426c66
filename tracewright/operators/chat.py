"""Conversations: role grammar, example assembly, loss masks, pairing of calls and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def conversations(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, messages): one row for each conversation, its messages in order."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(key).agg(packed.alias("messages"))


def roles(messages: Column) -> Column:
    """The initials of the roles, in order."""
    return F.array_join(F.transform(messages, lambda m: F.substring(m["role"], 1, 1)), "")


def follows_grammar(messages: Column, pattern: str = "^s?(ua)*u?$") -> Column:
    return roles(messages).rlike(pattern)


def merged_system(messages: Column) -> Column:
    """All system turns as one text; null where there is none."""
    own = F.filter(messages, lambda m: m["role"] == "system")
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda m: m["content"]), "\n\n"))


def loss_mask(messages: Column) -> Column:
    """1 for each assistant turn that answers a user turn, else 0."""
    return F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & (F.try_element_at(messages, i)["role"] == "user"), 1).otherwise(0))


def token_estimate(text: Column, bytes_per_token: int = 3) -> Column:
    return F.ceil(F.octet_length(text) / bytes_per_token).cast("long")


def length_bucket(tokens: Column) -> Column:
    return F.when(tokens.isNull(), "unknown").when(tokens <= 32_768, "le_32k").when(tokens <= 131_072, "le_128k").otherwise("over_128k")


def paired_turns(turns: DataFrame, key: str, order: str, role: str) -> DataFrame:
    """(key, turn, answered_by): each user turn with the assistant turn right after it, null where it dangles."""
    w = Window.partitionBy(key).orderBy(order)
    nxt, who = F.lead(order).over(w), F.lead(role).over(w)
    return turns.select(key, order, role, F.when(who == "assistant", nxt).alias("answered_by")).where(F.col(role) == "user").drop(role)
