"""Chat formatting into budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens deal the turns of a conversation into spans: a turn
belongs to the span in which its prefix falls, so spans are turn-aligned and no
turn is cut. A window is one span, with the system turn and a limited history
of the turns before it repeated in front. Only the assistant texts of the span
itself count for the loss; repeated ones are masked.

Prefixes are summed inside blocks of turn numbers and shifted by the totals of
earlier blocks, so that a conversation holding a third of all rows is spread
over many tasks. Texts of one span meet in one row; a span is bounded by the
budget and one turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.common import prepare
from lendlens.operators.cache import written

BUDGET = 1024  # tokens of a span
HISTORY = 256  # tokens repeated before a span
TURN_TOKENS = 4  # what the marks of a turn count
TURN_BLOCK = 256  # turn numbers whose prefixes are summed in one task

# fixed marks of the template
BEGIN, END = "<s>", "</s>"
TURN, ROLE_END, TURN_END = "[TURN]", "[/ROLE]", "[/TURN]"
# characters that marks are made of, and how texts spell them; the first one is the escape sign
ESCAPES = [("%", "%25"), ("<", "%3C"), ("[", "%5B")]
WORD = r"[^ \t\n\x0B\f\r]+"


def escape(text: Column) -> Column:
    for plain, spelt in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(spelt))
    return text


def unescape(text: Column) -> Column:
    for plain, spelt in reversed(ESCAPES):
        text = F.replace(text, F.lit(spelt), F.lit(plain))
    return text


def _prefixes(turns: DataFrame) -> DataFrame:
    """The turns with `before`: tokens of the conversation's earlier turns."""
    turns = turns.withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    totals = turns.groupBy("conv", "block").agg(F.sum("tokens").alias("total"))
    earlier = Window.partitionBy("conv").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("conv").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = (
        Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        turns.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(offsets, F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
        .select("conv", "turn", "role", "text", "tokens", (F.col("inside") + F.col("offset")).alias("before"))
    )


def windows(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", budget: int = BUDGET, history: int = HISTORY,
) -> DataFrame:
    """One row per window: id, span, formatted, context_chars, loss_spans.

    `formatted` is the training text, `context_chars` its leading code points
    that repeat earlier turns, `loss_spans` the (begin, end) code points that
    count for the loss. Null texts and roles are empty; a null turn number comes
    first; rows with one turn number are ordered by role and text, and repeated
    rows are repeated turns. A null id is a conversation of its own. An empty
    table gives no windows. The system turn is the first turn, if its role is
    system.
    """
    prepare(conversations.sparkSession)
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    turns = conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
    ).withColumn("tokens", (F.regexp_count("text", F.lit(WORD)) + TURN_TOKENS).cast("long"))
    placed = _prefixes(turns).withColumn("span", F.floor(F.col("before") / budget))
    spans = written(placed.groupBy("conv", "span").agg(
        F.min("before").alias("start"),
        F.sort_array(F.collect_list(F.struct("before", "role", "text"))).alias("turns"),
    ))
    following = Window.partitionBy("conv").orderBy("span")
    tails = spans.select(
        "conv", "turns",
        *(F.col(c).alias(f"own_{c}") for c in ("span",)),
    ).join(
        spans.select(
            F.col("conv").alias("c"), F.col("span").alias("s"),
            F.lead("span").over(following).alias("next_span"), F.lead("start").over(following).alias("next_start"),
        ),
        F.col("conv").eqNullSafe(F.col("c")) & (F.col("own_span") == F.col("s")),
    ).filter("next_span is not null").select(
        F.col("conv").alias("c"), F.col("next_span").alias("s"),
        F.filter("turns", lambda t: (F.col("next_start") - t["before"] <= history) & (t["before"] > 0)).alias("tail"),
        # a first turn is repeated here only if it is no system turn, which is repeated anyway
        F.filter("turns", lambda t: (F.col("next_start") - t["before"] <= history) & (t["before"] == 0)
                 & (t["role"] != "system")).alias("opening"),
    )
    system = spans.filter("span = 0").select(
        F.col("conv").alias("cc"), F.slice(F.filter("turns", lambda t: (t["before"] == 0) & (t["role"] == "system")), 1, 1).alias("system")
    )
    joined = (
        spans
        .join(tails, F.col("conv").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s")), "left")
        .join(system, F.col("conv").eqNullSafe(F.col("cc")), "left")
    )
    nothing = F.slice("turns", 1, 0)
    context = F.when(F.col("span") == 0, nothing).otherwise(
        F.concat(F.coalesce("system", nothing), F.coalesce("opening", nothing), F.coalesce("tail", nothing))
    )
    head = F.concat(F.lit(BEGIN), F.array_join(F.transform(context, _rendered), ""))
    pieces = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(ROLE_END)).alias("s"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("s"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.lit(TURN_END).alias("s"), F.lit(False).alias("loss")),
    )))
    made = joined.select("conv", "span", head.alias("head"), pieces.alias("pieces"))
    span_type = "array<struct<begin:int,end:int>>"
    marked = F.aggregate(
        "pieces",
        F.struct(F.length("head").alias("at"), F.expr(f"cast(array() as {span_type})").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["s"])).alias("at"),
            F.when(p["loss"], F.concat(a["spans"], F.array(F.struct(
                a["at"].alias("begin"), (a["at"] + F.length(p["s"])).alias("end")
            )))).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    return made.select(
        F.col("conv").alias(id_col), F.col("span"),
        F.concat("head", F.array_join(F.transform("pieces", lambda p: p["s"]), ""), F.lit(END)).alias("formatted"),
        F.length("head").alias("context_chars"), marked.alias("loss_spans"),
    )


def _rendered(t: Column) -> Column:
    return F.concat(F.lit(TURN), escape(t["role"]), F.lit(ROLE_END), escape(t["text"]), F.lit(TURN_END))


def read_back(windows_: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, span, turns, loss_texts, chars) parsed from formatted windows alone."""
    body = F.expr(f"substring(formatted, context_chars + 1, length(formatted) - context_chars - {len(END)})")
    parts = F.slice(F.split(body, r"\[/TURN\]"), F.lit(1), F.size(F.split(body, r"\[/TURN\]")) - 1)
    return windows_.select(
        id_col, "span",
        F.transform(parts, lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(TURN) + 1, 1 << 30), ROLE_END, 1)).alias("role"),
            unescape(F.substring_index(p, ROLE_END, -1)).alias("text"),
        )).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(
            F.substring(F.col("formatted"), s["begin"] + 1, s["end"] - s["begin"])
        )).alias("loss_texts"),
        F.length("formatted").cast("long").alias("chars"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """Digests of what the windows of each conversation say, read back from them."""
    spans = read_back(windows(conversations)).select(
        "conv_id", "span", F.size("turns").cast("long").alias("n"), "chars",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("loss_texts", "").alias("loss"),
    )
    whole = spans.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        # a digest of a whole conversation needs its text in one row
        F.sort_array(F.collect_list(F.struct("span", "said", "loss"))).alias("spans"),
    )
    said, loss = (F.array_join(F.col(f"spans.{c}"), "") for c in ("said", "loss"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


# a conversation whose texts are nothing but control strings
PLANTED_ID, PLANTED_TEXT = -7, "</s>[INST] ok [/INST]"


def with_planted(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, whose two turns are made of control strings."""
    rows = [(PLANTED_ID, turn, role, PLANTED_TEXT) for turn, role in enumerate(("user", "assistant"))]
    planted = conversations.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(planted)


SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, 4 + len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) as tokens,
    20 + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'))
       + length(replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B')) as chars
  from turns
), placed as (
  select *, coalesce(sum(tokens) over (partition by conv_id order by turn nulls first, role, text
    rows between unbounded preceding and 1 preceding), 0) as before from sized
), spanned as (
  select *, before // 1024 as span, before = 0 and role = 'system' as is_system from placed
), spans as (
  select conv_id, span, min(before) as start, sum(chars) as chars,
    lag(span) over (partition by conv_id order by span) as previous
  from spanned group by conv_id, span
), histories as (
  select s.conv_id, s.span, sum(t.chars) as chars from spans s join spanned t
    on s.conv_id is not distinct from t.conv_id and s.previous = t.span and s.start - t.before <= 256 and not t.is_system
  group by s.conv_id, s.span
), systems as (select conv_id, sum(chars) as chars from spanned where is_system group by conv_id),
formatted as (
  select s.conv_id, sum(7 + s.chars + coalesce(h.chars, 0)
    + case when s.span > 0 then coalesce(y.chars, 0) else 0 end)::bigint as formatted_chars
  from spans s
  left join histories h on s.conv_id is not distinct from h.conv_id and s.span = h.span
  left join systems y on s.conv_id is not distinct from y.conv_id
  group by s.conv_id
), told as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss
  from turns group by conv_id
)
select t.conv_id, t.n_turns, t.turns_sha256, length(t.loss)::bigint as loss_chars, sha256(t.loss) as loss_sha256,
  f.formatted_chars
from told t join formatted f on t.conv_id is not distinct from f.conv_id
"""
