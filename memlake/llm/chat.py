r"""Chat formatting with a grammar round trip, in DataFrame operations alone.

A rendered conversation is a run of turns, each

    [INST]ROLE[/INST]TEXT</s>

and the grammar lets no control string stand inside a text: a piece between two
[INST] has one [/INST], and </s> at its end alone. A deterministic parser reads
turns back by these rules. A turn is first rendered plainly and parsed; where
what it recovers is not the one turn of the source, its text is escaped, and the
whole conversation is parsed again and compared before it is given out. An escape
is a backslash after the first character of each control string, one more where
there are some already (`</s>` is `<\/s>`, `<\/s>` is `<\\/s>`), and the parser
takes one away, so any text has exactly one escaped form. A role of other
characters than ASCII letters, digits and _ is written as = and its bytes in
hexadecimal digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings (fixed values).
OPEN, HEAD_END, END = "[INST]", "[/INST]", "</s>"
#: A control string with any number of backslashes after its first character, and where one more is put in or taken out.
CONTROL = r"<\\*/s>|\[\\*/?INST\]"
_INTO = r"(?<=<)(?=\\*/s>)|(?<=\[)(?=\\*/?INST\])"
_OUT = r"(?<=<)\\(?=\\*/s>)|(?<=\[)\\(?=\\*/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _INTO, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OUT, "")


def _turn(role: Column, text: Column) -> Column:
    named = F.when(role.rlike("^[A-Za-z0-9_]*$") & ~role.contains("\n"), role).otherwise(F.concat(F.lit("="), F.hex(role)))
    return F.concat(F.lit(OPEN), named, F.lit(HEAD_END), text, F.lit(END))


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation; a turn that breaks the grammar is null."""

    def one(piece: Column) -> Column:
        head = F.substring_index(piece, HEAD_END, 1)
        body = F.substring(piece, F.length(head) + len(HEAD_END) + 1, F.length(piece))
        raw = F.substring(body, F.lit(1), F.length(body) - len(END))
        role = F.when(head.startswith("="), F.decode(F.unhex(F.substring(head, F.lit(2), F.length(head))), "UTF-8")).otherwise(head)
        # The first control strings after [INST] are one [/INST] and one </s>, with which the piece ends.
        whole = piece.contains(HEAD_END) & body.endswith(END) & ~raw.contains(HEAD_END) & ~raw.contains(END) & ~head.contains(END)
        return F.when(whole, F.struct(role.alias("role"), unescape(raw).alias("text")))

    pieces = F.split(rendered, r"\Q" + OPEN + r"\E", -1)
    return F.transform(F.filter(pieces, lambda p, i: (i > 0) | (p != "")), one)


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, rendered, n_escaped: one row per conversation, its rows in order of turn.

    A turn that the parser doesn't give back as it was, as its text holds a control
    string or looks like an escaped one, has its text escaped (n_escaped counts
    them); should the conversation still differ, the row fails the query. Null
    texts are empty, a null role is the role "". Rows of one turn number are ordered
    by role and text, repeated rows are repeated turns; a null conv_id is a
    conversation of its own, null turns come first. An empty table gives an empty
    result. The rows of a conversation meet in one row, as the output has it so;
    conversations are dealt by their ids. Other columns are not read.
    """
    source = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = _turn(F.col("role"), F.col("text"))
    same = F.coalesce(parse(plain) == F.array(F.struct("role", "text")), F.lit(False))
    tried = source.withColumn("escaped", ~F.when(F.col("text").rlike(r"[<\[]") | F.col("role").contains(END), same).otherwise(F.lit(True)))
    turn = F.struct("turn", "role", "text", "escaped")
    grouped = tried.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    rendered = F.array_join(F.transform("_turns", lambda t: _turn(t["role"], F.when(t["escaped"], escape(t["text"])).otherwise(t["text"]))), "")
    made = grouped.select("conv_id", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"), rendered.alias("rendered"), F.size(F.filter("_turns", lambda t: t["escaped"])).cast("long").alias("n_escaped"))
    ok = parse(F.col("rendered")) == F.col("source")
    return made.select("conv_id", F.when(ok, F.col("rendered")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip"))).alias("rendered"), "n_escaped")


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_escaped, from the rendered text alone.

    The loss mask covers assistant texts; n_escaped counts turns whose text is
    escaped. One row per input row, null ids, repeated rows and empty conversations
    included; an empty table gives an empty result.
    """
    parsed = rendered.select("conv_id", F.length("rendered").cast("long").alias("formatted_chars"), F.size(F.filter(F.split("rendered", r"\Q" + END + r"\E", -1), lambda p: p.rlike(_OUT))).cast("long").alias("n_escaped"), parse(F.col("rendered")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    digested = parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), loss.alias("_loss"), "formatted_chars", "n_escaped")
    return digested.select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_escaped")


def loss_spans(rendered: DataFrame) -> DataFrame:
    """conv_id, spans: array of (start, end) characters of the rendered text that are assistants' texts."""
    pieces = F.split("rendered", r"\Q" + END + r"\E", -1)
    sizes = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.length(p) + len(END))
    # The prefix sums run along one conversation.
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    spans = F.transform(sizes, lambda n, i: F.struct((F.element_at(ends, i + 1) + F.length(F.substring_index(F.element_at(pieces, i + 1), HEAD_END, 1)) + len(HEAD_END)).alias("start"), (F.element_at(ends, i + 2) - len(END)).alias("end"), F.startswith(F.element_at(pieces, i + 1), F.lit(OPEN + "assistant" + HEAD_END)).alias("_loss")))
    kept = F.filter(spans, lambda s: s["_loss"])
    return rendered.select("conv_id", F.transform(kept, lambda s: F.struct(s["start"], s["end"])).alias("spans"))
