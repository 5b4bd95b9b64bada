r"""Conversations as one training text each, by a template whose output a deterministic parser reads back.

The grammar of a formatted conversation, where a text holds no control string:

    conversation = turn*
    turn = "[INST] " text " [/INST]"          role user
         | "<s> " text " </s>"                role assistant
         | "<<SYS>> " text " <</SYS>>"        role system
         | "[TURN] " n ":" role " " text " [/TURN]"   any other role, n its characters as written

The parser cuts the text before every control string, wherever it stands, and takes the cuts in pairs, an
opening and its closing. Every pair of marker and text has a blank between, so no control string can arise
across a border.

Formatting is a round trip. A turn is rendered as it stands and parsed; if the turn read back differs from
the source, its text is rendered again with a backslash after the bracket that begins a control string (and
after a bracket that a backslash follows already), and at last with one after every bracket. Reading drops
one backslash after each bracket, so each way is reversible. The turns of a conversation are joined, parsed
and compared once more as a whole; a conversation that still differs would get the last way throughout.

Everything up to the joining works on single turns. A formatted conversation is one text, so its turns meet
in one row; that is the only gathering. Only DataFrame functions are used.

Null texts and null roles are empty. Turns follow their number, null first; rows with one number follow by
role, then by their formatted text; repeated rows are turns of their own. A null conversation id is one
conversation. Very long texts are whole texts like all others, up to what one row can hold. An empty table
gives an empty result. Only the four named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlens.llm.imatch import bound

# Fixed values of the template: role, opening, closing.
MARKS = (("user", "[INST] ", " [/INST]"), ("assistant", "<s> ", " </s>"), ("system", "<<SYS>> ", " <</SYS>>"))
OTHER = ("[TURN] ", " [/TURN]")
_SQUARE, _ANGLE = r"/?(?:INST|TURN)\]", r"/?s>|</?SYS>>"
_BEFORE_CONTROL = rf"(?=\[{_SQUARE}|<(?:{_ANGLE}))"
_CONFLICT = rf"(\[(?=\\|{_SQUARE})|<(?=\\|{_ANGLE}))"
_BRACKET = r"([\[<])"
LAST = 2  # the way that escapes every bracket


def escaped(text: Column, way: int) -> Column:
    """A backslash after no bracket (0), after brackets that could be misread (1), after all (2)."""
    return text if way == 0 else F.regexp_replace(text, _CONFLICT if way == 1 else _BRACKET, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\", "$1")


def rendered(role: Column, text: Column, way: int) -> Column:
    """One turn as formatted text."""
    name, body = escaped(role, way), escaped(text, way)
    out = F.concat(F.lit(OTHER[0]), F.char_length(name).cast("string"), F.lit(":"), name, F.lit(" "), body, F.lit(OTHER[1]))
    for known, opening, closing in MARKS:
        out = F.when(role == known, F.concat(F.lit(opening), body, F.lit(closing))).otherwise(out)
    return out


def _turn(left: Column, right: Column) -> Column:
    """(role, opening, body, closing) of an opening part and its closing part; null if they break the grammar."""

    def known(role: Column, opening: Column, body: Column, closing: str) -> Column:
        return F.struct(role.alias("role"), opening.alias("opening"), body.alias("body"), F.lit(closing).alias("closing"))

    def after(start, length) -> Column:
        return F.substring(left, start, length)

    size = F.char_length(left)
    digits = F.substring_index(F.substring(left, F.lit(len(OTHER[0]) + 1), size), ":", 1)
    head = F.lit(len(OTHER[0]) + 1) + F.char_length(digits)
    n = digits.cast("int")
    fits = left.startswith(OTHER[0]) & digits.rlike("^[0-9]{1,9}$") & (size >= head + n + 2) & (after(head + n + 1, F.lit(1)) == " ")
    out = F.when(fits & (F.concat(F.lit(" "), right) == OTHER[1]), known(unescaped(after(head + 1, n)), after(F.lit(1), head + n + 1), after(head + n + 2, size - head - n - 2), OTHER[1]))
    for role, opening, closing in MARKS:
        mine = left.startswith(opening) & left.endswith(" ") & (F.concat(F.lit(" "), right) == closing) & (size > len(opening))
        out = F.when(mine, known(F.lit(role), F.lit(opening), after(F.lit(len(opening) + 1), size - len(opening) - 1), closing)).otherwise(out)
    return out


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text as (role, opening, body, closing); a null among them is a breach of the grammar."""

    def pairs(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / 2).cast("int")), lambda i: _turn(F.get(parts, 2 * i), F.coalesce(F.get(parts, 2 * i + 1), F.lit(""))))

    return bound(F.split(formatted, _BEFORE_CONTROL), pairs)


def said(turn: Column) -> Column:
    """Role and text of a parsed turn as one string that tells any two turns apart."""
    return F.concat(F.char_length(turn["role"]).cast("string"), F.lit(":"), turn["role"], unescaped(turn["body"]))


def _written(turn: Column) -> Column:
    return F.concat(turn["opening"], turn["body"], turn["closing"])


def _round_trip(role: Column, text: Column, way: int) -> Column:
    """The rendered turn if it reads back as its source, else null."""
    source = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)

    def same(turns: Column, out: Column) -> Column:
        first = F.get(turns, F.lit(0))
        return (F.size(turns) == 1) & first.isNotNull() & (said(first) == source) & (_written(first) == out)

    return bound(rendered(role, text, way), lambda out: F.when(bound(parsed(out), lambda turns: F.coalesce(same(turns, out), F.lit(False))), out))


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, turns, escaped_turns): each conversation's text, what the parser reads back from it, and how many turns were escaped.

    ``turns`` has role, opening, body, closing, text and loss: opening, body and closing of all turns, one after
    the other, are the formatted text; bodies with ``loss`` are under the loss mask; ``text`` is the body unescaped.
    """
    blank = F.lit("")
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"))
    role, text = F.col("role"), F.col("text")
    ways = F.coalesce(*(_round_trip(role, text, way) for way in range(LAST)), rendered(role, text, LAST))
    rows = rows.select("conv_id", "turn", "role", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), role, text), 256).alias("source"), ways.alias("out"), rendered(role, text, 0).alias("plain"))
    rows = rows.select("conv_id", F.struct("turn", "role", "out", "source", (F.col("out") != F.col("plain")).cast("int").alias("changed")).alias("t"))
    joined = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def as_source(turns: Column, t: Column) -> Column:
        return F.coalesce(F.transform(turns, lambda x: F.sha2(said(x), 256)) == F.transform(t, lambda x: x["source"]), F.lit(False))

    def last_way(t: Column) -> Column:
        one = F.transform(t, lambda x: F.get(parsed(x["out"]), F.lit(0)))
        return F.array_join(F.transform(one, lambda x: rendered(x["role"], unescaped(x["body"]), LAST)), "")

    plain = F.array_join(F.col("t.out"), "")
    joined = joined.select("conv_id", "t", plain.alias("formatted"), F.aggregate("t", F.lit(0), lambda n, x: n + x["changed"]).alias("escaped_turns"))
    checked = joined.select("conv_id", "escaped_turns", F.when(as_source(parsed(F.col("formatted")), F.col("t")), F.col("formatted")).otherwise(last_way(F.col("t"))).alias("formatted"))
    loss = lambda x: x["role"] == "assistant"
    turns = F.transform(parsed(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), x["opening"].alias("opening"), x["body"].alias("body"), x["closing"].alias("closing"), unescaped(x["body"]).alias("text"), loss(x).alias("loss")))
    return checked.select("conv_id", "formatted", turns.alias("turns"), "escaped_turns")


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    read = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    under_loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    out = formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"), under_loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"), "escaped_turns")
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", F.col("escaped_turns").cast("long").alias("escaped_turns"))
