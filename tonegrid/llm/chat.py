"""Chat formatting from event logs: deltas, edits and regenerations are folded into messages, then rendered."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import union_all
from .common import small_batches, table

OPEN, ROLE_END, START, END = "[INST]", "[/INST]", "<s>", "</s>"
CONTROLS = (OPEN, ROLE_END, START, END)
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)

#: Events: ``open`` begins a message with a role, ``delta`` appends, ``edit`` replaces what came before it,
#: ``regenerate`` empties the message, ``delete`` removes it (a later open or edit brings it back).
RESETS = ("open", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    """A backslash inside every control string, and every backslash doubled: no control string is left."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(role: str, text: str) -> str:
    return f"{START}{OPEN}{escape(role)}{ROLE_END}{escape(text)}{END}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of rendered turns."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, message_id, seq, role, text)`` of events (conv_id, message_id, seq, kind, role, text).

    Events of one message meet by (conv_id, message_id), so a very long conversation is spread over tasks; sequence
    order inside a message settles resets first, and only what follows the last one is joined. NULL texts are
    empty. Events of a message that was never opened have an empty role. Equal sequence numbers go by text.
    """
    own = W.partitionBy("conv_id", "message_id").orderBy("seq", "text")
    resets = F.when(F.col("kind").isin(*RESETS), F.struct("seq", "text", "kind"))
    last = F.max(resets).over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    live = events.withColumn("__last", last)
    after = F.col("__last").isNull() | (F.struct("seq", "text", "kind") >= F.col("__last"))
    carries = after & ~F.col("kind").isin("regenerate", "delete")
    part = F.when(carries, F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))
    opened = F.when(F.col("kind") == "open", F.struct("seq", "role"))
    out = live.groupBy("conv_id", "message_id").agg(
        F.coalesce(F.min(opened)["seq"], F.min("seq")).alias("seq"),
        F.max(opened)["role"].alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "").alias("text"),
        F.max(F.col("__last.kind") == "delete").alias("gone"),
    )
    return out.where("NOT coalesce(gone, false)").drop("gone").fillna("", ["role", "text"])


TURN = "conv_id long, seq long, message_id long, formatted string, trained boolean"


def formatted_turns(messages: DataFrame) -> DataFrame:
    """Each message rendered; ``trained`` marks those whose text is under the loss mask."""

    @F.pandas_udf("string")
    def rendered(role: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([render(r, t) for r, t in zip(role, text)])

    columns = ["conv_id", "seq", "message_id", rendered("role", "text").alias("formatted"), (F.col("role") == "assistant").alias("trained")]
    return messages.select(*columns)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns sorted by conversation and sequence, read back one by one; nothing but running digests is kept."""

    def begin():
        return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

    def row(conv, s):
        return (None if pd.isna(conv) else int(conv), s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4])

    conv, state = None, None
    for batch in batches:
        out = []
        for own, text, trained in zip(batch["conv_id"], batch["formatted"], batch["trained"]):
            if state is None or not (own == conv or (pd.isna(own) and pd.isna(conv))):
                if state is not None:
                    out.append(row(conv, state))
                conv, state = own, begin()
            for role, said in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if trained:
                    state[2] += len(said)
                    state[3].update(said.encode())
            state[4] += len(text)
        yield _frame(out)
    if state is not None:
        yield _frame([row(conv, state)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")]).astype({"conv_id": "Int64"})


def read_back(turns: DataFrame) -> DataFrame:
    """Digests per conversation, streamed over its turns in order (a digest is sequential by nature)."""
    small_batches(turns.sparkSession)
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message_id")
    return dealt.select("conv_id", "formatted", "trained").mapInPandas(_read, READ)


#: Characters of one streamed delta in logs made from finished turns.
DELTA = 400


def as_events(conversations: DataFrame, delta: int = DELTA) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as the log that streams them: an opening, then deltas.

    Rows of one turn keep apart by a number in the order of role and text; NULL texts are empty.
    """
    twin = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    turns = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(twin).alias("twin"))
    seq = F.coalesce(F.col("turn").cast("decimal(30,0)") * (1 << 20), F.lit(-(2**62)).cast("decimal(30,0)"))
    base = (seq + F.col("twin")).cast("decimal(38,0)")
    # cut in one walk over the text, so a long message takes time in proportion to its length
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta}}}"), F.lit(0))
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("")))
    deltas = F.transform(parts, lambda part, i: F.struct(F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), part.alias("text"), (i * delta + 1).cast("long").alias("sub")))
    first = F.array(F.struct(F.lit("open").alias("kind"), "role", F.lit("").alias("text"), F.lit(0).cast("long").alias("sub")))
    rows = turns.select("conv_id", base.alias("message_id"), F.explode(F.concat(first, deltas)).alias("e"))
    return rows.select("conv_id", "message_id", F.struct("message_id", "e.sub").alias("seq"), "e.kind", "e.role", "e.text")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    return read_back(formatted_turns(fold(as_events(union_all(turns, extra)))))
