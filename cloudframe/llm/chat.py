"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans: a turn belongs to the window in whose ``budget`` tokens it starts.
Each window repeats the system turn and the last turns before it, ``history`` tokens at most.  The loss mask covers the
assistant texts of a window's own turns, never those that are repeated, so each is learned from once.

    <|im_start|>role
    text<|im_end|>

Control strings inside texts are escaped by one backslash between ``<`` and ``|`` (``<|`` becomes ``<\\|``, ``<\\|`` becomes
``<\\\\|``, and so on), which is taken out again on reading.  Texts are never cut: a window may exceed its budget by the
rest of its last turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from cloudframe.llm import common
from cloudframe.llm.common import C

#: Tokens (words, and two for the marks of a turn) of a window's own turns and of the history that it repeats.
BUDGET, HISTORY, MARKS = 512, 128, 2
#: Turn numbers of a part of a conversation: parts are summed on their own, so that a long one is many tasks.
CHUNK = 256
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text of ``(role, text, own)`` turns, and where the assistant texts of own turns are in it."""
    out, spans, at = [], [], 0
    for role, text, own in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if own and role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + END + "\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def windows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, formatted, loss_starts, loss_ends, n_repeated``: the windows of each conversation, in order.

    Turns go by ``turn``, NULL first, then role and text; repeated rows are turns of their own.  NULL roles and texts
    count as empty; NULL is a conversation id like any other.  Positions are code points.  Other columns are ignored.
    """
    rows = conversations.select(C(conv_id).alias("conv_id"), C(turn).alias("_turn"), F.coalesce(C(role), F.lit("")).alias("_role"), F.coalesce(C(text), F.lit("")).alias("_text"))
    words = F.size(F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("_t", (words + MARKS).cast("bigint")).withColumn("_chunk", F.floor(C("_turn") / CHUNK))
    inside = Window.partitionBy("conv_id", "_chunk").orderBy("_turn", "_role", "_text")
    rows = (rows.withColumn("_no", F.row_number().over(inside))
            .withColumn("_sum", F.sum("_t").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (rows.groupBy("conv_id", "_chunk").agg(F.sum("_t").alias("_all"), F.count(F.lit(1)).alias("_n"))
              .select("conv_id", "_chunk", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    rows = common.join_null_safe(rows, chunks, ["conv_id", "_chunk"])
    rows = (rows.withColumn("_end", C("_base") + C("_sum")).withColumn("_start", C("_end") - C("_t")).withColumn("_i", C("_first") + C("_no") - 1)
            .withColumn("_w", F.floor(C("_start") / budget)))
    # The next window starts where this one ends; the turns within `history` tokens before are repeated there.
    rows = rows.withColumn("_next", F.max("_end").over(Window.partitionBy("conv_id", "_w")))
    lead = (C("_i") == 0) & (C("_role") == "system")
    repeated = (F.floor(C("_next") / budget) > C("_w")) & (C("_next") - C("_start") <= history) & ~lead
    rows = rows.withColumn("_to", F.explode(F.filter(F.array(
        F.struct(C("_w").alias("w"), F.lit(2).alias("kind")),
        F.when(repeated, F.struct(F.floor(C("_next") / budget).alias("w"), F.lit(1).alias("kind")))), lambda x: x.isNotNull())))
    parts = rows.select("conv_id", C("_to.w").alias("_w"), C("_to.kind").alias("_kind"), "_i", "_role", "_text")
    systems = parts.where((C("_kind") == 2) & (C("_i") == 0) & (C("_role") == "system")).select("conv_id", "_role", "_text")
    later = parts.where("_kind = 2 AND _w > 0").select("conv_id", "_w").distinct()
    repeated_system = common.lookup(later, systems, ["conv_id"], ["_w"]).select("conv_id", "_w", F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_i"), "_role", "_text")
    grouped = (parts.unionByName(repeated_system).groupBy("conv_id", "_w")
               .agg(F.sort_array(F.collect_list(F.struct("_kind", "_i", "_role", "_text"))).alias("turns")).where(F.exists("turns", lambda x: x["_kind"] == 2)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [render([(t["_role"], t["_text"], t["_kind"] == 2) for t in turns]) for turns in frame["turns"]]
            yield pd.DataFrame({"conv_id": frame["conv_id"], "window": frame["_w"], "formatted": [m[0] for m in made],
                                "loss_starts": [[a for a, _ in m[1]] for m in made], "loss_ends": [[b for _, b in m[1]] for m in made],
                                "n_repeated": [sum(t["_kind"] < 2 for t in turns) for turns in frame["turns"]]})

    kind = conversations.schema[conv_id].dataType.simpleString()
    # Ids travel as text: pandas would turn whole numbers beside a NULL into doubles.
    made = grouped.withColumn("conv_id", C("conv_id").cast("string")).mapInPandas(
        run, "conv_id string, window bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>, n_repeated bigint")
    return made.withColumn("conv_id", C("conv_id").cast(kind))


def digest(made: DataFrame) -> DataFrame:
    """What can be read back from the windows of each conversation.

    A SHA-256 is sequential, so the windows of one conversation pass through one task, one after another; it holds one
    batch of windows and a running hash, however long the conversation is.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None

        def row() -> pd.DataFrame:
            n, turns, chars, loss, formatted = state
            return pd.DataFrame({"conv_id": pd.Series([current[0]], dtype=object), "n_turns": n, "turns_sha256": turns.hexdigest(),
                                 "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": formatted})

        for frame in frames:
            for id_, text, starts, ends, skip in zip(frame["conv_id"], frame["formatted"], frame["loss_starts"], frame["loss_ends"], frame["n_repeated"]):
                if current != (id_,):
                    if current is not None:
                        yield row()
                    current, state = (id_,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text)[skip:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends):
                    said = unescape(text[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
        if current is not None:
            yield row()

    kind = made.schema["conv_id"].dataType.simpleString()
    found = (made.repartition("conv_id").sortWithinPartitions("conv_id", "window").withColumn("conv_id", C("conv_id").cast("string"))
             .mapInPandas(run, "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"))
    return found.withColumn("conv_id", C("conv_id").cast(kind))
