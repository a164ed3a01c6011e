"""Chat formatting with DataFrame expressions only.

A declarative template marks the turns, a finite-state machine over the roles validates their order, and every
segment carries a loss flag. Control strings inside texts are escaped, so the output can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is `open`, the role's header, a space, the text, `close`. A role without a header is written out."""

    open: str = "<s>"
    close: str = " </s>"
    headers: dict[str, str] = field(default_factory=lambda: {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"})
    role_open: str = "[ROLE]"
    role_close: str = "[/ROLE]"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; anything else is the state "bad".
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
    )
    accepting: tuple[str, ...] = ("answered",)

    def controls(self) -> list[str]:
        return sorted({x.strip() for x in (self.open, self.close, self.role_open, self.role_close, *self.headers.values())})


#: An escape goes behind the first character of a control string, so that no control string is left in the text.
ESCAPE = "\\"


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/" else "\\" + c for c in text)


def escape(text: Column, template: Template) -> Column:
    rest = "|".join(f"(?<={_quoted(c[0])}){_quoted(c[1:])}" for c in template.controls())
    return F.regexp_replace(text, F.lit(rf"\\|{rest}"), F.lit(r"\\$0"))


def unescape(text: Column, template: Template) -> Column:
    rest = "|".join(f"(?<={_quoted(c[0])}\\\\){_quoted(c[1:])}" for c in template.controls())
    return F.regexp_replace(text, F.lit(rf"\\(\\|{rest})"), F.lit("$1"))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments (array of text and loss), final_state, valid.

    Reads conv_id, turn, role and text; turns go in order of (turn, role, text), so ties and repeated rows have a
    fixed place and all stay. A null text or role counts as empty, a null turn goes first, a null conv_id is a
    conversation of its own. A conversation whose roles break the machine's moves is still formatted, with valid
    false. An empty table gives no rows.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state} {role}", to)))
    told = told.withColumn(
        "final_state", F.aggregate("turns", F.lit("start"), lambda state, t: F.coalesce(F.try_element_at(moves, F.concat_ws(" ", state, t.role)), F.lit("bad")))
    )

    def header(role: Column) -> Column:
        known = F.concat(F.lit(template.role_open), escape(role, template), F.lit(template.role_close))
        for name, mark in template.headers.items():
            known = F.when(role == name, F.lit(mark)).otherwise(known)
        return known

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    pieces = F.transform(
        "turns",
        lambda t: F.array(
            segment(F.concat(F.lit(template.open), header(t.role), F.lit(" ")), F.lit(False)),
            segment(escape(t.text, template), t.role.isin(*template.loss_roles)),
            segment(F.lit(template.close), F.lit(False)),
        ),
    )
    return told.select("conv_id", F.flatten(pieces).alias("segments"), "final_state", F.col("final_state").isin(*template.accepting).alias("valid"))


def read_chats(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads formatted conversations back: conv_id, formatted, turns (array of role and text), loss_text."""
    out = chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s.text), "").alias("formatted"), "segments", "valid")

    def turn(block: Column) -> Column:
        known = [(F.lit(template.open + mark + " "), F.lit(name)) for name, mark in template.headers.items()]
        begin = F.lit(template.role_close + " ")
        at = F.position(begin, block)
        role = unescape(F.substr(block, F.lit(len(template.open + template.role_open) + 1), at - len(template.open + template.role_open) - 1), template)
        text = F.substr(block, at + F.length(begin))
        for mark, name in known:
            here = F.startswith(block, mark)
            role, text = F.when(here, name).otherwise(role), F.when(here, F.substr(block, F.length(mark) + 1)).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, template).alias("text"))

    blocks = F.split("formatted", _quoted(template.close.strip()).join([" " * template.close.startswith(" "), ""]), -1)
    blocks = F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turn)
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text, template)), "")
    return out.select("conv_id", "formatted", blocks.alias("turns"), loss.alias("loss_text"), "valid")


def digest(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


#: The conversation that the query adds.
ADDED_TEXT = "</s>[INST] ok [/INST]"
_CONTROLS = "|".join(_quoted(c) for c in Template().controls())
ORACLE_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{ADDED_TEXT}'), (-1, 1, 'assistant', '{ADDED_TEXT}')),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
      CAST(sum(length(text) + length(regexp_replace(text, '\\\\|{_CONTROLS}', '', 'g')) * 0 + len(regexp_extract_all(text, '\\\\|{_CONTROLS}'))
          + 3 + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 13 + length(role) + len(regexp_extract_all(role, '\\\\|{_CONTROLS}')) END + 1 + 5) AS BIGINT) AS formatted_chars,
      string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text) AS order_of
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       regexp_full_match(order_of, 's?(ua)+') AS valid FROM g"""
