"""Chat formatting (native): a role automaton and text segments with loss flags, from a declarative template.

A turn becomes three segments: header (role), body (text), close; only bodies of the template's loss roles carry loss.
Control strings inside texts and roles are escaped reversibly: a backslash becomes ``\\e``, and every control string gets
``\\x`` after its first character, so a formatted text holds control strings only where the template put them. What is
reported is read back from the formatted text, not from the input.

A conversation is one output row with one digest, so its turns meet in one task; nothing else does.

Defined results: rows go by (turn, role, text), nulls first, so ties are settled; null roles and texts are empty; rows of a
null conv_id form one conversation with a null id; repeated rows are turns of their own; an empty table gives the extra
conversations alone; very long texts are formatted whole; extra columns of the input are ignored; a conversation that breaks the turn order is formatted
all the same, with ``valid`` false and ``bad_turn`` the first turn (from 0) that the automaton refuses.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import let, running_sum, table


@dataclass(frozen=True)
class Template:
    open: str = "<|turn|>"
    after_role: str = "\n"
    close: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Strings that texts may not hold as they are; the template's own and those of other common templates.
    controls: tuple[str, ...] = (
        "<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    )
    start: str = "start"
    #: (state, role) -> state
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepting: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()
#: The conversation that contracts add: both turns hold another template's control strings.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    """No control string is left in the result."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\x" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.replace(F.replace(text, F.lit("\\x"), F.lit("")), F.lit("\\e"), F.lit("\\"))


def format_turns(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, formatted, spans (start and end, in code points, of the loss segments), valid, bad_turn per conversation."""
    role = F.coalesce("role", F.lit("")).alias("role")
    text = F.coalesce("text", F.lit("")).alias("text")
    ordered = F.sort_array(F.collect_list(F.struct("turn", role, text))).alias("turns")
    grouped = turns.groupBy("conv_id").agg(ordered)

    def segments(t: Column) -> Column:
        def segment(s: Column, loss: Column) -> Column:
            return F.struct(s.alias("text"), loss.alias("loss"))

        # a role stands on one line
        shown = F.replace(escape(t["role"], template), F.lit("\n"), F.lit("\\n"))
        return F.array(
            segment(F.concat(F.lit(template.open), shown, F.lit(template.after_role)), F.lit(False)),
            segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.close), F.lit(False)),
        )

    moves = F.create_map(*[F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s}\n{r}", to)])
    begin = F.struct(F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("i"))

    def move(at: Column, t: Column) -> Column:
        to = F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), t["role"]))
        return F.struct(
            F.coalesce(to, F.lit("refused")).alias("state"),
            F.coalesce(at["bad"], F.when(to.isNull(), at["i"])).alias("bad"),
            (at["i"] + 1).alias("i"),
        )

    made = grouped.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", begin, move).alias("walk"),
    )
    ends = running_sum(F.transform("segments", lambda s: F.length(s["text"]).cast("bigint")))
    placed = made.select("*", ends.alias("ends"))
    spans = F.filter(
        F.transform(
            "segments",
            lambda s, i: F.struct((F.get("ends", i) - F.length(s["text"])).alias("start"), F.get("ends", i).alias("end"), s["loss"].alias("loss")),
        ),
        lambda s: s["loss"],
    )
    return placed.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"),
        (F.col("walk.bad").isNull() & F.col("walk.state").isin(*template.accepting)).alias("valid"),
        F.col("walk.bad").alias("bad_turn"),
    )


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Adds ``turns`` (array of struct<role, text>) and ``loss_text``, taken from the formatted text and its mask."""
    parts = F.split("formatted", "\\Q" + template.open + "\\E", -1)

    def turn(p: Column) -> Column:
        at = F.instr(p, template.after_role)
        body = F.substring(p, at + 1, F.length(p) - at - len(template.close))
        role = F.replace(F.substring(p, F.lit(1), at - 1), F.lit("\\n"), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    masked = F.transform(
        "spans",
        lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return formatted.select(
        "*", F.transform(F.slice(parts, F.lit(2), F.size(parts)), turn).alias("turns"), F.array_join(masked, "").alias("loss_text")
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and one more, whose texts are nothing but control strings."""
    kinds, cols = dict(turns.dtypes), ("conv_id", "turn", "role", "text")
    said = [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)]
    rows = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for v, c in zip(r, cols)]) for r in said])
    probe = turns.sparkSession.range(1).select(F.inline(rows))
    return turns.select(*cols).unionByName(probe)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, formatted and read back."""
    back = read_back(format_turns(with_probe(table(spark, sf_dir, "conversations"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


#: DuckDB: the digests straight from the table; the length by the same escapes.
ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(text) + length(text) - length(replace(text, '\', ''))
    + 2 * list_sum(list_transform(['<|turn|>', '<|end|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|im_start|>', '<|im_end|>', '<|endoftext|>'],
      lambda c: (length(text) - length(replace(text, c, ''))) // length(c))) + length(role) + 8 + 1 + 8 as chars,
  row_number() over (partition by conv_id order by turn, role, text) as k from t),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by k) as said,
  coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '') as loss, sum(chars)::bigint as chars,
  string_agg(role, ',' order by k) as roles from e group by conv_id)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, chars as formatted_chars,
  regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') as valid from g
"""
