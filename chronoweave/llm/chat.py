"""Chat formatting by prefix-target expansion.

A conversation is rendered once, as a sequence of pieces, one per turn:
  <|role|> newline text <|end|> newline
Each assistant turn is an example of its own: its context is all that is rendered before its text, its
target that text, and only the target is trainable. Since every context is a prefix of the one rendering,
an example is stored as offsets into it; expand() writes the texts out. Storage thus stays in proportion
to the input, however long a conversation.

Control strings inside roles and texts are escaped: backslashes double, and a backslash follows the first
character of every control string. A backslash before any character takes it literally, which undoes both.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import Workspace

# The template's own marks and control strings of common chat templates.
CONTROL = ("<|", "|>", "[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>")
TRAINED = "assistant"
_HEAD, _MID, _END = "<|", "|>\n", "<|end|>\n"
_STARTS = "(?s)(?=" + "|".join(re.escape(c).replace("<", "\\<") for c in CONTROL) + ")(.)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _STARTS, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(conversations: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The written output: pieces (conv_id, seq, piece) and examples (conv_id, example, seq, target_start, target_end).

    seq orders all pieces; offsets are characters in the conversation's rendering. Turns are sorted by range,
    so a long conversation spans several tasks, and offsets are sums over parts before sums within one.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    by = ["conv_id", "turn", "role", "text"]
    ordered = own.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id())
    head = F.concat(F.lit(_HEAD), escape(F.col("role")), F.lit(_MID))
    body = escape(F.col("text"))
    pieces = ordered.select("conv_id", "seq", F.concat(head, body, F.lit(_END)).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"), (F.col("role") == TRAINED).alias("trained"))
    pieces = ws.stage(pieces, "pieces")

    part = F.shiftright("seq", 33)
    sized = pieces.select("conv_id", "seq", "head", "body", "trained", part.alias("part"), (F.col("head") + F.col("body") + len(_END)).cast("long").alias("chars"))
    sums = sized.groupBy("conv_id", "part").agg(F.sum("chars").alias("n"), F.count_if("trained").alias("k"))
    over = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n"), F.coalesce(F.sum("k").over(over), F.lit(0)).alias("k"))
    inside = Window.partitionBy("conv_id", "part").orderBy("seq")
    placed = sized.withColumns({"upto": F.sum("chars").over(inside), "ordinal": F.count_if("trained").over(inside)}).where("trained")
    sums = ws.stage(sums, "sums").toDF("c", "p", "n", "k")
    placed = placed.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    start = F.col("n") + F.col("upto") - len(_END) - F.col("body")
    examples = placed.select("conv_id", (F.col("k") + F.col("ordinal")).alias("example"), "seq", start.alias("target_start"), (start + F.col("body")).alias("target_end"))
    return pieces.select("conv_id", "seq", "piece"), ws.stage(examples, "examples")


def expand(pieces: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples written out: conv_id, example, context, target. For readers; the output grows with the square of a conversation's turns."""
    before = examples.withColumnRenamed("seq", "at").join(pieces.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seq") <= F.col("at")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "")
    whole = before.groupBy("conv_id", "example", "target_start", "target_end").agg(text.alias("text"))
    return whole.select("conv_id", "example", F.substring("text", F.lit(1), F.col("target_start").cast("int")).alias("context"), F.substring("text", (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int")).alias("target"))


def read_back(pieces: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation, from the written output: turns, digests of turns and of what is under the loss mask, the
    number of examples, and examples_sha256 over them all: the hex digest of their own hex digests, one after
    another, each of context, NUL and target, where the context is the rendering up to the target's start.

    A hash of the rendering so far is carried along and copied at each target, so every example is read whole
    in linear time. A digest runs over a conversation in order, so its pieces come to one task, sorted; they stream through
    it and are never held together.
    """
    mask = examples.select(F.col("conv_id").alias("c"), F.col("seq").alias("s"), "target_start", "target_end")
    masked = pieces.join(mask, F.col("seq") == F.col("s"), "left").select("conv_id", "seq", "piece", "target_start", "target_end")
    ordered = masked.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    plain = re.compile(r"\\(.)", re.S)

    def run(batches):
        now, any_ = None, False
        turns = sha = lost = under = chars = shown = so_far = pairs = None

        def done():
            return {"conv_id": now, "n_turns": turns, "turns_sha256": sha.hexdigest(), "loss_chars": under, "loss_sha256": lost.hexdigest(), "formatted_chars": chars, "n_examples": shown, "examples_sha256": pairs.hexdigest()}

        for batch in batches:
            out = []
            for conv, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "target_start", "target_end")), strict=True):
                if not any_ or conv != now:
                    if any_:
                        out.append(done())
                    now, any_, turns, under, chars, shown = conv, True, 0, 0, 0, 0
                    sha, lost, so_far, pairs = (hashlib.sha256() for _ in range(4))
                cut = piece.index(_MID)
                role, text = plain.sub(r"\1", piece[len(_HEAD) : cut]), plain.sub(r"\1", piece[cut + len(_MID) : -len(_END)])
                sha.update(f"{role}\n{text}\n".encode())
                if a is not None:
                    written = piece[a - chars : b - chars]
                    example = so_far.copy()
                    example.update(f"{piece[: a - chars]}\0{written}".encode())
                    pairs.update(example.hexdigest().encode())
                    target = plain.sub(r"\1", written)
                    lost.update(target.encode())
                    under += len(target)
                    shown += 1
                so_far.update(piece.encode())
                turns += 1
                chars += len(piece)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_DIGEST)
        if any_:
            yield pa.RecordBatch.from_pylist([done()], schema=_DIGEST)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, examples_sha256 string")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64()), ("examples_sha256", pa.string())])


def format_and_read(conversations: DataFrame) -> DataFrame:
    """Write all conversations and read them back, one row each.

    Turns are ordered by turn, nulls first, ties by role and text; repeated rows are turns of their own.
    Null roles and texts are empty; a null conv_id is a conversation like any other. One without assistant
    turns has no example and an empty loss. A text of any length is one piece; the longest bounds what a task
    holds. Other columns are not read.
    """
    ws = Workspace(conversations.sparkSession, "chat")
    return read_back(*render(conversations, ws))
