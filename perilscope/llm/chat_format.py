"""Chat formatting by a declarative template, with DataFrame functions only.

A finite-state machine walks the roles of a conversation in turn order and
tells whether the order is valid (an optional system turn, then user and
assistant in alternation). Every turn becomes three segments, its opening
mark, its text and its closing mark, each with a loss flag from the template;
only assistant texts carry loss. The formatted text is the segments joined.

Control strings inside texts are escaped: the escape character is doubled and
every control string is broken after its first character by ``ESCAPE + "."``.
No control string is left in an escaped text, and unescaping restores it.

Defined results: null text is empty; a null role is the empty role; roles
without an entry in the template use ``OTHER`` with the role inside the mark,
and make the order invalid; turns sort by (turn, role, text), nulls first, so
repeated turns are kept and tie-broken; a null conv_id is a conversation.
A conversation is one output value, so its turns meet in one group.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"

# Role -> opening mark, closing mark, loss flag of the text.
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<s> ", " </s>\n", True),
}
OTHER = ("<<ROLE>>", "<</ROLE>>", "<<TURN>>", "<</TURN>>\n")
CONTROL = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>",
           "<<ROLE>>", "<</ROLE>>", "<<TURN>>", "<</TURN>>"]

# State -> role -> next state; a missing entry is an invalid turn.
MACHINE = {
    "start": {"system": "prompt", "user": "reply"},
    "prompt": {"user": "reply"},
    "reply": {"assistant": "prompt"},
}
# A conversation may end in these states.
FINAL = ["prompt", "reply"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + "." + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|\.)", "$1")


def valid_order(roles: Column) -> Column:
    """Run the machine over an array of roles."""
    moves = F.create_map(*[F.lit(x) for s, to in MACHINE.items() for r, n in to.items()
                           for x in (f"{s}/{r}", n)])
    end = F.aggregate(roles, F.lit("start"),
                      lambda s, r: F.coalesce(moves[F.concat_ws("/", s, r)], F.lit("invalid")))
    return end.isin(FINAL)


def segments(turns: Column) -> Column:
    """Segments of ``array<struct<role, text>>``: struct<text, loss> in order."""
    def turn(t: Column) -> Column:
        head = F.concat(F.lit(OTHER[0]), escape(t["role"]), F.lit(OTHER[1] + OTHER[2]))
        tail, loss = F.lit(OTHER[3]), F.lit(False)
        for role, (a, b, flag) in TEMPLATE.items():
            is_role = t["role"] == role
            head = F.when(is_role, F.lit(a)).otherwise(head)
            tail = F.when(is_role, F.lit(b)).otherwise(tail)
            loss = F.when(is_role, F.lit(flag)).otherwise(loss)
        seg = lambda x, f: F.struct(x.alias("text"), f.alias("loss"))
        return F.array(seg(head, F.lit(False)), seg(escape(t["text"]), loss),
                       seg(tail, F.lit(False)))
    return F.flatten(F.transform(turns, turn))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``segments``, ``formatted``."""
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = (turns.groupBy("conv_id")
               .agg(F.sort_array(F.collect_list("t")).alias("turns"))
               .select("conv_id", valid_order(F.transform("turns", lambda t: t["role"]))
                       .alias("valid"), segments(F.col("turns")).alias("segments")))
    return grouped.withColumn("formatted", F.array_join(
        F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """Read turns back from a formatted text: array<struct<role, text, loss>>.

    Escaped texts hold no control string, so the marks alone delimit turns.
    """
    forms = [(re.escape(a), re.escape(b)) for a, b, _ in TEMPLATE.values()]
    other = (re.escape(OTHER[0]) + "(?:.*?)" + re.escape(OTHER[1] + OTHER[2]),
             re.escape(OTHER[3]))
    every = "(?s)(?:" + "|".join(f"{a}.*?{b}" for a, b in [*forms, other]) + ")"

    def turn(piece: Column) -> Column:
        named = f"(?s)^{re.escape(OTHER[0])}(.*?){re.escape(OTHER[1])}"
        role = unescape(F.regexp_extract(piece, named, 1))
        body = F.regexp_extract(piece, f"(?s)^{other[0]}(.*){other[1]}$", 1)
        loss = F.lit(False)
        for name, (a, b, flag) in TEMPLATE.items():
            own = piece.startswith(a)
            role = F.when(own, F.lit(name)).otherwise(role)
            body = F.when(own, F.substring(piece, F.lit(len(a) + 1),
                                           F.length(piece) - len(a) - len(b))).otherwise(body)
            loss = F.when(own, F.lit(flag)).otherwise(loss)
        return F.struct(role.alias("role"), unescape(body).alias("text"), loss.alias("loss"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(every), F.lit(0)), turn)
