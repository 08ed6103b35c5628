"""Chat formatting with a grammar round trip.

A conversation is rendered by a template of control strings. The rendered text is parsed again by a deterministic
grammar, each turn is compared with its source, and turns that come back changed are rendered with escapes. The grammar:

    conversation := "<s>" turn* "</s>"
    turn         := "[INST] " text " [/INST]"  |  "[OUT] " text " [/OUT]"  |  "[SYS] " text " [/SYS]"
                  | "[ROLE] " role " [SAYS] " text " [/ROLE]"  |  "[NONE] " text " [/NONE]"

for user, assistant, system, any other role, and no role. In a text or role a backslash before "\\", "[" or "<" stands
for that character alone, so that no control string of the template occurs inside.

Turns are ordered by turn, then role, then text; nulls first. A null text is empty. Repeated rows are turns of their own;
rows without conv_id form one conversation. An empty table gives what the extra conversations give. Other columns are
ignored. A conversation is one row of output, so it must fit in a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template: role, opening, closing.
TEMPLATE = (("user", "[INST] ", " [/INST]"), ("assistant", "[OUT] ", " [/OUT]"), ("system", "[SYS] ", " [/SYS]"))
OTHER = ("[ROLE] ", " [SAYS] ", " [/ROLE]")
NONE = ("[NONE] ", " [/NONE]")
BEGIN, END = "<s>", "</s>"
OPENINGS = [o for _, o, _ in TEMPLATE] + [OTHER[0], NONE[0]]
CLOSINGS = [c for _, _, c in TEMPLATE] + [OTHER[2], NONE[1]]


def quoted(s: str) -> str:
    return "".join("\\" + x if x in "[]\\." else x for x in s)


#: One turn: opening, what stands between, closing. Texts have no closing: a backslash parts its blank from its bracket.
TURN = rf"(?s)({'|'.join(map(quoted, OPENINGS))})(.*?)({'|'.join(map(quoted, CLOSINGS))})"
#: What a text may not hold if it is to come back as it is.
CONFLICT = r"\\[\\\[<]|\[(?:INST|OUT|SYS|ROLE|SAYS|NONE)\] | \[/(?:INST|OUT|SYS|ROLE|NONE)\]|</?s>"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\\[<])", r"\\$1")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\\[<])", "$1")


def render(role: Column, text: Column) -> Column:
    """One turn; both are already escaped where needed."""
    out = F.when(role.isNull(), F.concat(F.lit(NONE[0]), text, F.lit(NONE[1])))
    for name, opening, closing in TEMPLATE:
        out = out.when(role == name, F.concat(F.lit(opening), text, F.lit(closing)))
    return out.otherwise(F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]), text, F.lit(OTHER[2])))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of rendered text, still under the mask of its grammar."""
    opens = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    bodies = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))

    def turn(x: Column) -> Column:
        opening, body = x["opens"], x["bodies"]
        other, none = opening == OTHER[0], opening == NONE[0]
        cut = F.regexp_extract(body, rf"(?s)^(.*?){quoted(OTHER[1])}(.*)$", 1)
        rest = F.regexp_extract(body, rf"(?s)^(.*?){quoted(OTHER[1])}(.*)$", 2)
        role = F.when(none, F.lit(None).cast("string"))
        for name, o, _ in TEMPLATE:
            role = role.when(opening == o, F.lit(name))
        return F.struct(role.otherwise(unescaped(cut)).alias("role"), F.when(other, unescaped(rest)).otherwise(unescaped(body)).alias("text"))

    return F.transform(F.arrays_zip(opens.alias("opens"), bodies.alias("bodies")), turn)


def one(role: Column, text: Column) -> Column:
    """Whether a turn that is rendered without escapes comes back as the same single turn."""
    plain = render(role, text)
    back = F.regexp_extract(plain, TURN, 2)
    start = F.when(F.regexp_extract(plain, TURN, 0) == plain, back)
    known = role.isNull() | role.isin([n for n, _, _ in TEMPLATE])
    return F.coalesce(known & (unescaped(start) == text), F.lit(False)) & ~text.rlike(CONFLICT)


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, source (the turns as given) and formatted."""
    t = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    free = one(F.col("role"), F.col("text"))
    known = F.col("role").isNull() | F.col("role").isin([n for n, _, _ in TEMPLATE])
    wire = F.when(free, render(F.col("role"), F.col("text"))).otherwise(render(F.when(known, F.col("role")).otherwise(escaped(F.col("role"))), escaped(F.col("text"))))
    t = t.withColumn("wire", wire)
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "wire"))).alias("t"))
    whole = lambda turns: F.concat(F.lit(BEGIN), F.array_join(turns, ""), F.lit(END))
    g = g.select("conv_id", "t", F.expr("transform(t, x -> named_struct('role', x.role, 'text', x.text))").alias("source"), whole(F.transform("t", lambda x: x["wire"])).alias("plain"))
    # the whole is read again; one that comes back changed has all its texts escaped
    same = F.to_json(read_back("plain")) == F.to_json("source")
    role = lambda x: F.when(x["role"].isNull() | x["role"].isin([n for n, _, _ in TEMPLATE]), x["role"]).otherwise(escaped(x["role"]))
    return g.select("conv_id", "source", F.when(same, F.col("plain")).otherwise(whole(F.transform("source", lambda x: render(role(x), escaped(x["text"]))))).alias("formatted"))


def read_back(formatted: str) -> Column:
    return parse(F.expr(f"substring({formatted}, {len(BEGIN) + 1}, length({formatted}) - {len(BEGIN) + len(END)})"))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations gets; fails if any conversation doesn't come back as it was."""
    d = formatted.withColumn("back", read_back("formatted"))
    d = d.withColumn("back", F.when(F.to_json("back") == F.to_json("source"), F.col("back")).otherwise(F.raise_error(F.concat(F.lit("a conversation doesn't come back as it was: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
    loss = F.expr("array_join(transform(filter(back, x -> x.role = 'assistant'), x -> x.text), '')")
    turns = F.expr("array_join(transform(back, x -> concat(coalesce(x.role, ''), '\\n', x.text, '\\n')), '')")
    d = d.select("conv_id", "formatted", F.size("back").cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"))
    return d.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
