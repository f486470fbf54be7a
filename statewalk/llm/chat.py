"""Chat formatting with a grammar that reads its own output back.

    conversation := turn*
    turn         := START role NEWLINE body END NEWLINE

No control string may occur in a role or a body, and a role holds no newline.
Texts that would break this are escaped: whatever is written is parsed again and
compared with its source, so escaping is decided by the parser, not by a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the control strings of the template
START = "<|im_start|>"
END = "<|im_end|>"
NEWLINE_IN_ROLE = "<|nl|>"


def quoted(text: str) -> str:
    return rf"\Q{text}\E"


def escape(text: Column) -> Column:
    """Puts one more backslash between each `<` and `|`, so no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Takes one backslash away from between `<` and `|`; undoes `escape`."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END), F.lit("\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered text; a null entry where it breaks the grammar.

    Text between START marks must end in the only END, and its first newline
    ends the role.  Anything before the first START is an error, too.
    """
    parts = F.split(formatted, quoted(START), -1)
    tail = len(END) + 1

    def turn(part: Column) -> Column:
        content = F.substring(part, F.lit(1), F.length(part) - tail)
        role = F.substring_index(content, "\n", 1)
        body = F.substring(content, F.length(role) + 2, F.length(content))
        well_formed = (
            F.endswith(part, F.lit(END + "\n"))
            & ~F.contains(content, F.lit(END))
            & F.contains(content, F.lit("\n"))
        )
        name = unescape(F.replace(role, F.lit(NEWLINE_IN_ROLE), F.lit("\n")))
        return F.when(well_formed, F.struct(name.alias("role"), unescape(body).alias("text")))

    turns = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), turn)
    broken = F.array(F.lit(None).cast("struct<role:string,text:string>"))
    return F.when(F.get(parts, 0) == "", turns).otherwise(F.concat(broken, turns))


def reads_back(role: Column, text: Column, rendered: Column) -> Column:
    """Whether the parser gets exactly this turn out of the rendered text."""
    turns = parse(rendered)
    same = F.get(turns, 0)
    return F.coalesce(
        (F.size(turns) == 1) & (same["role"] == role) & (same["text"] == text), F.lit(False)
    )


def safe(role: Column, text: Column) -> tuple[Column, Column]:
    """Role and text as they go into the template, escaped where the round trip fails."""
    one_line = F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE_IN_ROLE))
    probe = F.lit("user")
    plain_role = reads_back(role, F.lit(""), render(role, F.lit("")))
    plain_text = reads_back(probe, text, render(probe, text))
    return F.when(plain_role, role).otherwise(one_line), F.when(plain_text, text).otherwise(escape(text))


def format_chats(
    turns: DataFrame,
    trained: tuple[str, ...] = ("assistant",),
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: the id, segments and formatted.

    `segments` is an array of (text, loss); the texts in a row are `formatted`,
    and those with `loss` are the bodies of turns whose role is in `trained`.
    Rows are ordered by turn, then role and text; null turns come last.  Null
    role and null text count as empty; rows with a null id make a conversation
    of their own; repeated rows are repeated turns; an empty table gives an
    empty result.  Other columns are not looked at.  A conversation is one
    value, so its text must fit a row.

    Turns are escaped and rendered before they are gathered.  The whole text is
    parsed again at the end; a difference from the source would raise an error.
    """
    name, body = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    safe_role, safe_body = safe(F.col("role"), F.col("text"))
    rows = (
        turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), name.alias("role"), body.alias("text"))
        .select("*", safe_role.alias("safe_role"), safe_body.alias("safe_text"))
        .groupBy("conv")
        .agg(F.collect_list(F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text", "safe_role", "safe_text")).alias("turns"))
        .select("conv", F.array_sort("turns").alias("turns"))
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(F.concat(F.lit(START), t["safe_role"], F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
                F.struct(t["safe_text"].alias("text"), t["role"].isin(*trained).alias("loss")),
                F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    rows = rows.select("conv", "turns", segments.alias("segments")).select(
        "conv", "turns", "segments", F.array_join(F.col("segments.text"), "").alias("formatted")
    )
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(parse(F.col("formatted")) == source, F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not read back as it was"))
    )
    return rows.select(F.col("conv").alias(conv), "segments", checked.alias("formatted"))


def loss_text(segments: Column) -> Column:
    """The texts under the loss mask, unescaped, in order with nothing between."""
    kept = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(kept, lambda s: unescape(s["text"])), "")
