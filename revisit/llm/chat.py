"""Chat formatting: a state machine over roles and a declarative template.

``format_conversations`` orders the turns of each conversation, runs the
template's state machine over their roles and emits the formatted conversation
as segments ``(text, loss)``. The concatenated segments are the training text;
the loss flag marks what a model is trained on. Control strings inside texts are
escaped, so ``read_back`` recovers roles and texts from the formatted string.

All of it is DataFrame functions. A conversation is one row of the output, so
its turns meet in one row; they are shuffled once, on the conversation.

Defined results: a null text or role is empty; a null turn sorts first; turns
that share a number are ordered by role, then text; repeated rows stay separate
turns; a null ``conv_id`` is a conversation of its own; an empty table gives no
rows; columns other than the four are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What is written around each turn, which turns may follow, what is learned.

    ``open`` + role + ``sep`` + text + ``close`` is one turn. ``moves`` maps a
    state and a role to the next state (the state after a turn is named by it);
    a conversation is valid if it ends in one of ``final``.
    """

    open: str = "<|im_start|>"
    sep: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple[str, ...] = ("assistant",)


CHATML = ChatTemplate()
_CONTROL = "<|"  # every control string of a template starts with it


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\0`` and ``<|`` becomes ``<\|``: afterwards no control string
    is left, and every ``\`` is followed by ``0`` or ``|``, so it can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit(_CONTROL), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit(_CONTROL)), F.lit("\\0"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_conversations(rows: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """One row per conversation: ``conv_id``, ``segments`` (array of text, loss),
    ``formatted``, ``valid`` and ``bad_turn`` (position of the first turn that the
    machine does not allow; null if there is none)."""
    if not (template.open.startswith(_CONTROL) and template.close.startswith(_CONTROL)):
        raise ValueError(f"a template's open and close strings start with {_CONTROL}")
    turns = (rows.select("conv_id", F.struct(
                F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    moves = F.create_map(*[F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}\n{r}", to)])

    def step(acc: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(acc["state"], F.lit("\n"), t["role"]))
        ok = acc["bad"].isNull() & to.isNotNull()
        return F.struct(F.when(ok, to).otherwise(acc["state"]).alias("state"),
                        (acc["n"] + 1).alias("n"),
                        F.when(ok, F.lit(None).cast("int")).otherwise(F.coalesce(acc["bad"], acc["n"])).alias("bad"))

    zero = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(template.open), escape_role(t["role"]), F.lit(template.sep)), F.lit(False)),
        segment(escape(t["text"]), t["role"].isin(*template.loss_roles)),
        segment(F.lit(template.close), F.lit(False)))))
    return (turns.withColumn("run", F.aggregate("turns", zero, step)).withColumn("segments", segments)
            .select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"),
                    (F.col("run.bad").isNull() & F.col("run.state").isin(*template.final)).alias("valid"),
                    F.col("run.bad").alias("bad_turn")))


def read_back(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """The turns (role, text) of a formatted conversation, by its control strings."""
    pieces = F.split(formatted, f"\\Q{template.close}\\E")
    body = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1),
                       lambda p: F.substr(p, F.lit(len(template.open) + 1)))
    n = len(template.sep)
    return F.transform(body, lambda b: F.struct(
        unescape_role(F.substring_index(b, template.sep, 1)).alias("role"),
        unescape(F.substr(b, F.instr(b, template.sep) + F.lit(n))).alias("text")))


def digest_columns(formatted: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Counts and digests taken from the formatted output, not from the input rows."""
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    return (formatted.withColumn("back", read_back(F.col("formatted"), template)).withColumn("learned", loss)
            .select("conv_id", F.size("back").cast("bigint").alias("n_turns"),
                    F.sha2(F.array_join(F.transform("back", lambda t: F.concat(
                        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
                    F.length("learned").cast("bigint").alias("loss_chars"),
                    F.sha2("learned", 256).alias("loss_sha256"),
                    F.length("formatted").cast("bigint").alias("formatted_chars"),
                    "valid"))
