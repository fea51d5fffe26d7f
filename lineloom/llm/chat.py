r"""Reply trees to training conversations.

Messages form trees by parent. Iterative self-joins double the reach of parent pointers until every leaf has the whole
path to its root; paths are ranked by score within their tree; each chosen path becomes one formatted conversation.

Template: a turn is ``### role:\n``, the text, ``\n</turn>\n``. Inside roles and texts ``\`` becomes ``\\``, ``###`` becomes
``\###``, ``</`` becomes ``\</`` and (in roles) ``:`` becomes ``\:``; so markers appear only unescaped and reading back is exact.

Edge cases: null text or role is empty; rows of equal turn are ordered by role, text; repeated rows are turns of their own;
a message whose parent is missing is a root; columns besides the named ones are ignored. Rows of a null conversation
id form one conversation with a null id.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

TRAINED_ROLE = "assistant"


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace("###", "\\###").replace("</", "\\</")
    return text.replace(":", "\\:") if role else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], trained: str = TRAINED_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """(formatted conversation, loss spans: escaped texts of the trained role)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, True)}:\n", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "\n</turn>\n"]
        at += len(head) + len(body) + 9
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation: an escape takes the next character with it, so a bare </ ends a turn."""
    turn = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\<]|<(?!/)|\\.)*)\n</turn>\n", re.S)
    return [(unescape(m[1]), unescape(m[2])) for m in turn.finditer(formatted)]


def linear(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages (id, parent, tree, role, text, score) of conversations whose turns answer one another in order."""
    m = messages.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    m = m.withColumn("n", F.row_number().over(w))
    key = lambda n: F.concat_ws(":", F.coalesce(F.col("tree").cast("string"), F.lit("null")), n)
    return m.select(key(F.col("n")).alias("id"), F.when(F.col("n") > 1, key(F.col("n") - 1)).alias("parent"), "tree", "role", "text", F.lit(0.0).alias("score"))


def paths(scratch: Scratch, messages: DataFrame) -> DataFrame:
    """(leaf, id, up): every message on the way from each leaf (up = 0) to its root.

    Pointer doubling: after round i, rows reach 2^i messages up and jumps span 2^i, so a tree of depth d takes log2(d)
    rounds of two joins and holds no more rows than the result. Messages in a loop without a leaf are left out.
    """
    ids = messages.select("id", "parent")
    jump = ids.join(ids.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi").select("id", F.col("parent").alias("to"))
    leaves = ids.join(ids.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    jump, reach = scratch.keep(jump), scratch.keep(leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).alias("up")))
    step = 1
    while not jump.isEmpty():
        more = reach.join(jump, "id").select("leaf", F.col("to").alias("id"), (F.col("up") + step).alias("up"))
        reach = scratch.keep(reach.unionByName(more))
        jump = scratch.keep(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("then")), "to").select("id", F.col("then").alias("to")))
        step *= 2
    return reach


def chosen(scratch: Scratch, messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, rank, up, role, text): the best paths of each tree, by mean message score, then length, then leaf."""
    reach = paths(scratch, messages)
    full = reach.join(messages, "id")
    score = full.groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")
    top = score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("leaf", "rank")
    return full.join(top, "leaf").select("tree", "leaf", "rank", "up", "role", "text")


def conversations(messages: DataFrame, best: int = 1, trained: str = TRAINED_ROLE) -> DataFrame:
    """(tree, rank, formatted, loss array<struct<start, end>>) per chosen path of messages (id, parent, tree, role, text, score)."""
    scratch = Scratch(messages.sparkSession, "chat")
    turns = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns")
    rows = chosen(scratch, scratch.keep(messages), best).groupBy("tree", "leaf", "rank").agg(turns)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            text, loss = [], []
            for turns in b.column("turns").to_pylist():
                f, s = render([(t["role"], t["text"]) for t in turns], trained)
                text.append(f)
                loss.append([{"start": x, "end": y} for x, y in s])
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("rank"), pa.array(text, pa.string()), pa.array(loss, span)], names=["tree", "rank", "formatted", "loss"])

    kind = dict(messages.dtypes)["tree"]
    return rows.select("tree", "rank", "turns").mapInArrow(run, f"tree {kind}, rank int, formatted string, loss array<struct<start:int,end:int>>")


def digest(formatted: DataFrame) -> DataFrame:
    """What reading formatted conversations back gives, as the query returns it."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for f, spans in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist()):
                turns = parse(f)
                loss = "".join(unescape(f[s["start"] : s["end"]]) for s in spans)
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(loss))
                out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                out["formatted_chars"].append(len(f))
            yield pa.RecordBatch.from_arrays([b.column("tree"), *(pa.array(v) for v in out.values())], names=["conv_id", *out])

    return formatted.select("tree", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
