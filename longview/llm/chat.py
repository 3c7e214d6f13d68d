"""Conversations to training text: a state machine over roles, and segments with loss flags from a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm.common import table


@dataclass(frozen=True)
class Template:
    """``marks``: what opens and closes a turn of each role; other roles are named between ``other``'s first two marks.

    ``moves``: (state, role) to the next state; ``final``: states in which a conversation may end. ``loss``: roles that are learnt.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: tuple[str, ...] = ("answered",)
    loss: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair} | set(self.other), key=lambda m: (-len(m), m))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|/" else c for c in text)


def escape(text: Column, template: Template) -> Column:
    """Doubles backslashes, then puts one after the first character of every control string: none is left in the text."""
    firsts = {}
    for m in template.controls():
        firsts.setdefault(m[0], []).append(m[1:])
    inside = "|".join(f"{_quoted(a)}(?={'|'.join(_quoted(r) for r in rest)})" for a, rest in firsts.items())
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({inside})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column, template: Template) -> Column:
    """The three segments of a turn: opening mark, escaped text, closing mark; only the text of a learnt role counts for the loss."""
    opened = F.concat(F.lit(template.other[0]), escape(turn["role"], template), F.lit(template.other[1]))
    closed = F.lit(template.other[2])
    for role, (a, b) in template.marks.items():
        opened = F.when(turn["role"] == role, F.lit(a)).otherwise(opened)
        closed = F.when(turn["role"] == role, F.lit(b)).otherwise(closed)
    one = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(one(opened, F.lit(False)), one(escape(turn["text"], template), turn["role"].isin(*template.loss)), one(closed, F.lit(False)))


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments (text and loss flag each), formatted (their texts joined), state, bad_turn and valid of every conversation.

    ``rows``: conv_id, turn, role, text, one row a turn. Null texts and roles are empty; null ids make one conversation; turns of
    one number are ordered by role, then text, and each counts. ``bad_turn`` is the place (from 0) of the first turn that the
    state machine has no move for, null if none; such conversations are formatted all the same. A conversation becomes one string,
    so its turns meet in one row.
    """
    template = template or Template()
    empty = F.lit("")
    turns = rows.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\x00{role}", to)])
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(now: Column, turn: Column) -> Column:
        to = F.try_element_at(moves, F.concat(now["state"], F.lit("\x00"), turn["role"]))
        return F.struct(F.when(now["bad"].isNull() & to.isNotNull(), to).otherwise(now["state"]).alias("state"), (now["at"] + 1).alias("at"),
                        F.when(now["bad"].isNull() & to.isNull(), now["at"]).otherwise(now["bad"]).alias("bad"))

    ran = chats.select("conv_id", "turns", F.aggregate("turns", begin, step).alias("m"), F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"))
    return ran.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("m.state").alias("state"),
                      F.col("m.bad").alias("bad_turn"), (F.col("m.bad").isNull() & F.col("m.state").isin(*template.final)).alias("valid"))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns (role, text) of a formatted conversation."""
    template = template or Template()
    opens = "|".join(_quoted(a) for a, _ in template.marks.values())
    closes = "|".join(_quoted(b) for b in [*(b for _, b in template.marks.values()), template.other[2]])
    pattern = f"(?s)(?:{_quoted(template.other[0])}(.*?){_quoted(template.other[1])}|({opens}))(.*?)(?:{closes})"
    part = lambda k: F.regexp_extract_all(formatted, F.lit(pattern), F.lit(k))

    def turn(x: Column) -> Column:
        role = unescape(x["0"])
        for name, (a, _) in template.marks.items():
            role = F.when(x["1"] == a, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(x["2"]).alias("text"))

    return F.transform(F.arrays_zip(part(1).alias("0"), part(2).alias("1"), part(3).alias("2")), turn)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from every formatted conversation, and of one whose texts are control strings (id -1)."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = format_chats(rows)
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    back = chats.select("conv_id", "formatted", "valid", read_back(F.col("formatted")).alias("turns"), learnt.alias("learnt"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
                       F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, CASE WHEN role = 'system' THEN 15 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7 ELSE 25 END AS marks,
             length(regexp_replace(replace(text, '\', '\\'), '(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<<ROLE>>|<<TEXT>>|<</ROLE>>)', '\1~', 'g')) AS chars,
             CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 ELSE
             length(regexp_replace(replace(role, '\', '\\'), '(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<<ROLE>>|<<TEXT>>|<</ROLE>>)', '\1~', 'g')) END AS named FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(marks + chars + named)::BIGINT AS formatted_chars,
       regexp_full_match(string_agg(CASE WHEN role = 'system' THEN 's' WHEN role = 'user' THEN 'u' WHEN role = 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text),
                         's?(ua)+') AS valid
FROM e GROUP BY conv_id
"""

QUERIES = {"op3_chat_format": (op3_chat_format, SQL)}
