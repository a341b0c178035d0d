"""The transcript machine: one ordered fold over the messages of each conversation, whose state holds the calls that wait.

A conversation is one row (its length is bounded by a model's context), so the fold is Spark's ``aggregate`` over a sorted array and
needs one shuffle, by conversation. Faults come out as rows with the position of the message that makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strict_json

CALL = "struct<id: string, name: string, arguments: string>"
FAULT = "struct<position: int, fault: string, id: string>"
STATE = f"struct<position: int, pending: array<string>, asked: array<string>, answered: array<string>, faults: array<{FAULT}>>"


def conversations_of(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, messages: role, content, calls, answers of each conversation in order. turns has these columns; calls is an array
    of (id, name, arguments), answers the id that a tool message answers."""
    message = F.struct(F.col(order).alias("at"), "role", "content", F.coalesce("calls", F.array().cast(f"array<{CALL}>")).alias("calls"), "answers")
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def _fault(position: Column | None, name: str, id_: Column | None = None) -> Column:
    position, id_ = (F.lit(None) if x is None else x for x in (position, id_))
    return F.array(F.struct(position.cast("int").alias("position"), F.lit(name).alias("fault"), id_.cast("string").alias("id")))


def _step(last: Column):
    """What a message does to the state. last: the position of the final answer, or null."""

    def run(s: Column, m: Column) -> Column:
        late = F.coalesce(s.position > last, F.lit(False))
        ids = F.transform(m.calls, lambda c: c.id)
        asks = (m.role == "assistant") & (F.size(ids) > 0)
        answers = (m.role == "tool") & (F.coalesce(m.answers, F.lit("")) != "")
        empty = F.array().cast(f"array<{FAULT}>")
        fits = answers & ~late & (F.size(s.pending) > 0) & (F.try_element_at(s.pending, F.lit(1)) == m.answers)
        found = (
            F.when(asks & late, _fault(s.position, "call_after_answer"))
            .when((m.role == "tool") & ~answers, _fault(s.position, "tool_without_id"))
            .when(answers & late, _fault(s.position, "tool_after_answer", m.answers))
            .when(answers & (F.size(s.pending) == 0), _fault(s.position, "tool_before_call", m.answers))
            .when(answers & ~F.coalesce(fits, F.lit(False)), _fault(s.position, "out_of_order", m.answers))
            .when(~F.coalesce(m.role.isin("assistant", "tool", "system", "user"), F.lit(False)), _fault(s.position, "role", m.role))
            .otherwise(empty)
        )
        pending = F.when(asks, F.concat(s.pending, ids)).when(fits, F.slice(s.pending, 2, F.greatest(F.size(s.pending), F.lit(1)))).otherwise(s.pending)
        return F.struct(
            (s.position + 1).alias("position"),
            pending.alias("pending"),
            F.when(asks, F.concat(s.asked, ids)).otherwise(s.asked).alias("asked"),
            F.when(answers, F.array_append(s.answered, m.answers)).otherwise(s.answered).alias("answered"),
            F.concat(s.faults, found).alias("faults"),
        ).cast(STATE)

    return run


def final_position(messages: Column) -> Column:
    """Where the last assistant message without calls and with a content stands, from 0; null if there is none."""
    final = F.transform(messages, lambda m, i: F.when((m.role == "assistant") & (F.size(m.calls) == 0) & (F.coalesce(m.content, F.lit("")) != ""), i))
    return F.array_max(final)


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no spaces; what is no JSON stays as it is."""
    return F.coalesce(F.to_json(strict_json(json)), json)


def transcript_faults(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, position (from 0; null if the fault is of the whole), fault, id: a row for each fault of each conversation.

    conversations: key, messages (as ``conversations_of`` gives them), expected (array of call_id, name, arguments) and
    expected_answer. Of messages in order: a call or a tool message behind the final answer, a tool message without an id, before
    any call, or that does not answer the call that waits longest (which goes on waiting), and other roles. Of the whole:
    unanswered (still waiting at the end), never_answered (asked, and no tool message has the id) and unknown_id (the
    other way). Of calls against what is expected: undeclared, name, arguments (as JSON values). Of the answer:
    answer_missing, no_answer, answer_differs.
    """
    last = F.col("_last")
    rows = conversations.withColumn("_last", final_position(F.col("messages")))
    empty = F.struct(F.lit(0).alias("position"), *[F.array().cast("array<string>").alias(c) for c in ("pending", "asked", "answered")], F.array().cast(f"array<{FAULT}>").alias("faults")).cast(STATE)
    rows = rows.withColumn("_end", F.aggregate("messages", empty, _step(last)))
    end = F.col("_end")
    whole = lambda ids, name: F.transform(ids, lambda i: F.struct(F.lit(None).cast("int").alias("position"), F.lit(name).alias("fault"), i.alias("id")))

    def against(m: Column, at: Column) -> Column:
        def one(c: Column) -> Column:
            want = F.try_element_at(F.filter("expected", lambda e: e.call_id == c.id), F.lit(-1))
            name = F.when(want.isNotNull() & (want["name"] != c["name"]), _fault(at, "name", c.id)).otherwise(F.array().cast(f"array<{FAULT}>"))
            args = F.when(want.isNotNull() & ~canonical(want.arguments).eqNullSafe(canonical(c.arguments)), _fault(at, "arguments", c.id)).otherwise(F.array().cast(f"array<{FAULT}>"))
            return F.when(want.isNull(), _fault(at, "undeclared", c.id)).otherwise(F.concat(name, args))

        return F.when(m.role == "assistant", F.flatten(F.transform(m.calls, one))).otherwise(F.array().cast(f"array<{FAULT}>"))

    content = F.try_element_at("messages", last + 1).content
    answer = F.when(F.col("expected_answer").isNull(), _fault(None, "answer_missing")).when(last.isNull(), _fault(None, "no_answer")).when(content != F.col("expected_answer"), _fault(last, "answer_differs")).otherwise(F.array().cast(f"array<{FAULT}>"))
    found = F.concat(
        end.faults,
        whole(end.pending, "unanswered"),
        whole(F.array_except(end.asked, end.answered), "never_answered"),
        whole(F.array_except(end.answered, end.asked), "unknown_id"),
        F.flatten(F.transform("messages", against)),
        answer,
    )
    return rows.select(key, F.explode(found).alias("_f")).select(key, "_f.position", "_f.fault", "_f.id")


def call_answers(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, id, asked_at, answered_at: a full outer join by id of calls and the tool messages that name them, first ones of
    each. A null on either side is a call without an answer, or an answer to no call."""
    at = conversations.select(key, F.posexplode("messages").alias("at", "m"))
    asked = at.where("m.role = 'assistant'").select(key, "at", F.explode("m.calls.id").alias("id")).groupBy(key, "id").agg(F.min("at").alias("asked_at"))
    answered = at.where("m.role = 'tool' and m.answers <> ''").groupBy(key, F.col("m.answers").alias("id")).agg(F.min("at").alias("answered_at"))
    return asked.join(answered, [key, "id"], "full_outer")
