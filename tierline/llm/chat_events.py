"""Chat formatting from an event log.

A conversation is stored as events (conv_id, seq, msg, op, role, text):

* ``message``     starts message ``msg`` with its role and first text,
* ``delta``       appends a streamed piece,
* ``edit``        replaces the text so far,
* ``regenerate``  drops the text so far; later deltas build it anew.

Events are folded per message in order of ``seq`` (a message is a key of its
own, so a conversation holding a third of all events is spread like the rest).
Messages are then placed in their conversation by their first ``seq`` and
rendered one by one as

    <s>[INST] role [/INST]text</s>

with the control strings inside roles and texts escaped by a backslash after
their first character (one more where backslashes stand there already), which is
undone exactly by taking one away.  Only assistant text is under the loss mask.

Reading back parses the rendered turns and digests every conversation in order.
Partitions are sorted by conversation and place and run through as a stream:
one batch of turns is held at a time, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Template marks and the other control strings that are escaped.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
RESETS = ("message", "edit", "regenerate")
LOSS_ROLE = "assistant"

_TAILS = {c: "|".join(re.escape(s[1:]) for s in CONTROL if s[0] == c) for c in ("<", "[")}
#: Control string, with any number of backslashes after its first character.
_RAW = "|".join(rf"{re.escape(c)}\\*(?=(?:{t}))" for c, t in _TAILS.items())
_UNESCAPE = re.compile("(" + "|".join(rf"{re.escape(c)}\\*(?=\\(?:{t}))" for c, t in _TAILS.items()) + r")\\")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(MIDDLE) + r"(.*?)" + re.escape(CLOSE), re.S)


def escaped(text: Column) -> Column:
    """Text with a backslash put behind the first character of each control string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"({_RAW})", r"$1\\")


def unescape(text: str) -> str:
    """Inverse of ``escaped``."""
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, place, role, text) of an event log.

    Per (conv_id, msg) in order of seq (ties: resets first, then by text): the
    text is that of the last reset (empty for ``regenerate``) followed by the
    deltas after it; the role is the last non-null one.  ``place`` is the first
    seq.  Null text counts as empty, null role stays null, null conv_id or msg
    are keys like others; repeated events count each; events of an unknown op
    change nothing.  Empty log: no messages.
    """
    first = F.when(F.col("op").isin(*RESETS), 0).otherwise(1)
    text = F.when(F.col("op") == "regenerate", F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    known = events.filter(F.col("op").isin(*RESETS, "delta"))
    log = known.select("conv_id", "msg", "seq", "role", F.struct(
        F.col("seq").alias("seq"), first.alias("late"), text.alias("text")).alias("e"))
    folded = log.groupBy("conv_id", "msg").agg(
        F.min("seq").alias("place"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        F.array_sort(F.collect_list("e")).alias("log"),
        F.max(F.when(F.col("e.late") == 0, F.col("e"))).alias("reset"))
    kept = F.filter("log", lambda e: F.col("reset").isNull() | (e >= F.col("reset")))
    # equal resets (repeated events) would each start the text: keep the first, which leads the sorted list
    started = F.filter(kept, lambda e, i: (e["late"] == 1) | (i == 0))
    return folded.select("conv_id", "msg", "place", "role",
                         F.array_join(F.transform(started, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Messages with ``formatted`` (the rendered turn) and the loss span in it.

    ``loss_from`` and ``loss_to`` are code-point offsets of the text under the
    loss mask within the rendered turn, null for other roles.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(MIDDLE))
    body = escaped(F.col("text"))
    out = messages.withColumn("__head", head).withColumn("__body", body)
    is_loss = F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False))
    return out.withColumn("formatted", F.concat("__head", "__body", F.lit(CLOSE))) \
        .withColumn("loss_from", F.when(is_loss, F.length("__head"))) \
        .withColumn("loss_to", F.when(is_loss, F.length("__head") + F.length("__body"))) \
        .drop("__head", "__body")


_DIGEST = ("conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests per conversation, read from the rendered turns alone.

    A conversation's turns come in order of place; equal places in order of
    their rendered form.  Every turn must parse back whole, otherwise the task fails.
    """
    def stream(batches):
        conv, live = None, None
        for batch in batches:
            out = []
            for c, formatted, lf, lt in zip(batch["conv_id"], batch["formatted"], batch["loss_from"], batch["loss_to"]):
                if live is None or c != conv:      # ids travel as strings: exact, and null stays None
                    if live is not None:
                        out.append(_closed(conv, live))
                    conv, live = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = _TURN.fullmatch(formatted)
                if m is None:
                    raise ValueError(f"a turn of conversation {c} does not parse back")
                live[0] += 1
                live[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                if not pd.isna(lf):
                    under = unescape(formatted[int(lf):int(lt)])
                    live[2] += len(under)
                    live[3].update(under.encode("utf-8", "surrogatepass"))
                live[4] += len(formatted)
            if out:
                yield _digests(out)
        if live is not None:
            yield _digests([_closed(conv, live)])

    ordered = rendered.select(F.col("conv_id").cast("string"), "place", "formatted", "loss_from", "loss_to") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "place", "formatted").drop("place")
    return ordered.mapInPandas(stream, _DIGEST).withColumn("conv_id", F.col("conv_id").cast("long"))


def _digests(rows):
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _DIGEST.split(", ")])


def _closed(conv, live):
    return conv, live[0], live[1].hexdigest(), live[2], live[3].hexdigest(), live[4]


def log_of_rows(conversations: DataFrame) -> DataFrame:
    """An event log from rows (conv_id, turn, role, text): every row is a message
    whose first line opens it and whose further lines are streamed as deltas."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"),
                                F.monotonically_increasing_id().alias("msg"))
    lines = rows.select("conv_id", "turn", "role", "msg", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    opens = F.col("line") == 0
    return lines.select("conv_id", F.struct("turn", "line").alias("seq"), "msg",
                        F.when(opens, F.lit("message")).otherwise(F.lit("delta")).alias("op"),
                        F.when(opens, F.col("role")).alias("role"),
                        F.when(opens, F.col("text")).otherwise(F.concat(F.lit("\n"), "text")).alias("text"))


def format_conversations(spark, sf_dir: str) -> DataFrame:
    """Contract query: all conversations and the planted conversation -7."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet") \
        .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], told.schema)
    return read_back(render(fold_events(log_of_rows(told.unionByName(planted)))))
