"""Chat formatting by replaying event logs.

A log holds events (conv_id, seq, msg, kind, role, text). Per message the events are folded in order of seq: `message`,
`edit` and `regenerate` set the text, `delta` adds to what is there; the last role that is given holds. Messages are
then rendered one by one with turn markers, so that a conversation of any length is never one row, and a streaming
pass over a conversation's pieces in order needs a constant amount of memory.

A log is dealt out by conversation once; counting, folding and the pass in order all use that partitioning, so texts are sent
once. A hash of a conversation needs its turns in order and so one task for each conversation, however long: that task sorts
outside memory and holds one message at a time.

Escaping is reversible: in texts a backslash is doubled and `<|` becomes `<\\|`; in roles a line feed also becomes `\\n`.
No escaped text holds `<|`, so only the template's own markers do.

Defined cases: a null text is empty, a null role is `user`, a null kind is `message`; an event that comes twice with
equal seq and content counts once; deltas with equal seq are added in order of their text; a message whose events are
all empty stays as an empty turn; conversations without an id are one; ids may be of any type that has an order; an empty
log gives no rows; extra columns of the log are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
SETS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, msg, role, text): each message as its events leave it."""
    event = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    grouped = log.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_set(event)).alias("e"))
    sets = ", ".join(f"'{k}'" for k in SETS)
    # the last event that sets the text; what follows it can only add
    last = grouped.withColumn("at", F.expr(f"coalesce(array_max(filter(transform(e, (x, i) -> if(x.kind IN ({sets}), i, -1)), i -> i >= 0)), 0)"))
    return last.select("conv_id", "msg", F.expr("coalesce(get(reverse(filter(e.role, r -> r IS NOT NULL)), 0), 'user')").alias("role"), F.expr("array_join(transform(slice(e, at + 1, size(e)), x -> x.text), '')").alias("text"))


def render(messages: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, msg, role, piece, loss_start, loss_end): the formatted turns; the loss mask in code points of the piece, null outside it."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    text = escape(F.col("text"))
    masked = F.col("role") == loss_role
    parts = messages.select("conv_id", "msg", "role", head.alias("head"), text.alias("body"), masked.alias("masked"))
    start = F.when(F.col("masked"), F.length("head").cast("long"))
    return parts.select("conv_id", "msg", "role", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), start.alias("loss_start"), (start + F.length("body")).alias("loss_end"))


def format_conversations(log: DataFrame, loss_role: str = LOSS_ROLE, *, dealt: bool = False) -> DataFrame:
    """The rendered turns of a log; `dealt` says that rows of one conversation share a partition already."""
    return render(fold_events(log if dealt else log.repartition("conv_id")), loss_role)


def joined(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask): whole conversations, for those that fit in a row; `digests` needs no such row."""
    turns = rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg", "piece", "loss_start", "loss_end"))).alias("t"))
    step = "struct(a.pos + length(x.piece) AS pos, if(x.loss_start IS NULL, a.mask, concat(a.mask, array(struct(a.pos + x.loss_start AS start, a.pos + x.loss_end AS end)))) AS mask)"
    mask = f"aggregate(t, struct(0L AS pos, cast(array() AS array<struct<start:bigint,end:bigint>>) AS mask), (a, x) -> {step}, a -> a.mask)"
    return turns.select("conv_id", F.expr("array_join(t.piece, '')").alias("formatted"), F.expr(mask).alias("loss_mask"))


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not (piece.startswith(START) and piece.endswith(END + "\n")):
        raise ValueError("not a formatted turn")
    role, _, text = piece[len(START) : -len(END) - 1].partition("\n")
    return unescape(role), unescape(text)


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and hashes of each conversation, read back from its pieces in order by a streaming pass."""
    # the window sorts each conversation, and deals rows out anew only if they are not by conversation
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("msg"))
    ordered = rendered.select("conv_id", at.alias("at"), "piece", "loss_start", "loss_end")
    columns = {"n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(), "loss_sha256": T.StringType(), "formatted_chars": T.LongType()}
    schema = T.StructType([rendered.schema["conv_id"], *[T.StructField(k, v) for k, v in columns.items()]])
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out, ids = None, [], []
        kind = None

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=schema.names)

        for b in batches:
            kind = b.schema.field("conv_id").type
            for conv, at, piece, start, end in zip(*(b.column(c) for c in ("conv_id", "at", "piece", "loss_start", "loss_end")), strict=True):
                if at.as_py() == 1:  # a conversation begins
                    if state:
                        out.append((state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    ids.append(conv.as_py())
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                piece = piece.as_py()
                role, text = parse_piece(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start.is_valid:
                    masked = unescape(piece[start.as_py() : end.as_py()])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if out:
                last = ids.pop()
                yield made()
                ids, out = [last], []
        if state:
            out.append((state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
            yield made()

    return ordered.mapInArrow(run, schema)


def conversation_log(rows: DataFrame, deltas: int = 1) -> DataFrame:
    """A log, dealt out by conversation, from rows (conv_id, turn, role, text); each row is a message of its own, equal rows too.

    With `deltas` above 1 an assistant's row is the stream that made it: an empty message, and so many deltas at most.
    """
    own = rows.select("conv_id", "turn", "role", "text").repartition("conv_id")
    n = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    numbered = own.select("conv_id", F.struct("turn", n.alias("n")).alias("msg"), "role", F.coalesce("text", F.lit("")).alias("text"))
    size = f"ceil(length(text) / {deltas})"
    parts = f"transform(sequence(1, {deltas}), i -> struct(cast(i AS int) AS seq, 'delta' AS kind, substring(text, cast((i - 1) * {size} + 1 AS int), cast({size} AS int)) AS text))"
    streamed = f"concat(array(struct(0 AS seq, 'message' AS kind, '' AS text)), filter({parts}, x -> x.text <> ''))"
    whole = "array(struct(0 AS seq, 'message' AS kind, text AS text))"
    events = F.expr(f"if(role = '{LOSS_ROLE}' AND {deltas} > 1, {streamed}, {whole})")
    return numbered.select("conv_id", "msg", "role", F.inline(events)).select("conv_id", "seq", "msg", "kind", "role", "text")
