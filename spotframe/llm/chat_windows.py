r"""Chat formatting into budgeted, turn-aligned windows, in DataFrame operations only.

A turn is written ``### role\ntext</turn>\n``.  Control strings inside roles and texts are
escaped (the backslash first, so the escape can be undone whatever a text holds).

Turns of a conversation are ordered by (turn, role, text), null turn first, null role and
null text as empty.  A turn costs the bytes of its written form: no byte-level vocabulary
makes more tokens of a text than it has bytes, so a window within the budget is within it
for every such tokenizer.  ``cost`` takes another native estimate (a Column of the written
form) where windows may be filled more closely.  Let S be the cost of the conversation's
leading system turn (0 without one) and span = (budget - history - S) / 2, at least 1.
With P the prefix sum of the costs before a turn:

- turns whose P lies in the same block of ``span`` form one window; a turn that alone
  costs more than a span gets a window of its own.  Every turn is new in exactly one
  window;
- a leading system turn is repeated at the head of every later window;
- before its new turns a window repeats the turns whose cost back to its start fits in
  ``history``, in a span, and in what the budget leaves;
- the loss mask covers the text of new assistant turns only: repeated ones are masked.

A window exceeds the budget only where one turn and the system turn do so by themselves;
turns are never cut, so it is written whole and flagged ``over_budget``.

Prefix sums run in two levels, within runs of ``RUN`` turn numbers and over the runs, so
a conversation that holds a third of all rows is still dealt over many tasks.  Very long
texts are turns like any other, rows that repeat are separate turns, further columns are
ignored whatever their names.  A table without rows gives no windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.session import stage

BUDGET, HISTORY = 2048, 512
RUN = 256
HEAD, END = "### ", "</turn>"
_ESCAPES = [("\\", "\\0"), (END, "\\1"), (HEAD, "\\2"), ("\n", "\\3")]


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in _ESCAPES if role else _ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def token_bound(piece: Column) -> Column:
    """At least as many as the tokens of any byte-level vocabulary."""
    return F.octet_length(piece)


def _with_span(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Adds head (cost of the conversation's leading system turn, or 0) and span."""
    first = turns.groupBy("conv").agg(F.min(F.struct("turn", "role", "body", "cost")).alias("first"))
    head = F.when(F.col("first.role") == "system", F.col("first.cost")).otherwise(F.lit(0).cast("long"))
    room = F.floor((F.lit(budget - history) - F.col("head")) / 2)
    return turns.join(first.select("conv", head.alias("head")), "conv").withColumn("span", F.greatest(room, F.lit(1).cast("long")))


def _positions(turns: DataFrame) -> DataFrame:
    """Adds at (position in the conversation), before (tokens before), big and bigs (turns
    longer than a span before)."""
    key = ["conv", "run"]
    order = ["turn", "role", "body"]
    here = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("run", F.floor(F.col("turn") / RUN)).withColumn("big", (F.col("cost") > F.col("span")).cast("long"))
    runs = rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("big").alias("big"))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = runs.select(F.struct(*key).alias("k"),
                       *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"{c}0") for c in ("n", "cost", "big")])
    rows = rows.select("*", F.struct(*key).alias("k"), F.count("*").over(here).alias("n1"),
                       *[F.coalesce(F.sum(c).over(here), zero).alias(f"{c}1") for c in ("cost", "big")])
    return (rows.join(runs, "k").withColumn("at", F.col("n0") + F.col("n1"))
            .withColumn("before", F.col("cost0") + F.col("cost1"))
            .withColumn("bigs", F.col("big0") + F.col("big1"))
            .select("conv", "role", "piece", "cost", "at", "before", "big", "bigs", "head", "span"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY,
            cost: Callable[[Column], Column] = token_bound) -> DataFrame:
    """Windows of ``conversations(conv_id, turn, role, text)``: conv_id, window_start (position
    of its first new turn), text, n_tokens (sum of costs), over_budget, repeated (turns at its
    head that are not new), loss (spans of code points in text: start from 0, length)."""
    if not 0 <= history < budget:
        raise ValueError("history must be within the budget")
    role, body = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.struct(F.col("conv_id").alias("id")).alias("conv"), F.col("turn"),
                                 role.alias("role"), escape(body).alias("body"))
    turns = turns.withColumn("piece", F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit("\n"),
                                               F.col("body"), F.lit(f"{END}\n")))
    turns = turns.withColumn("cost", F.greatest(cost(F.col("piece")), F.lit(1)).cast("long"))
    # read by four branches below: written once, in the shared folder
    rows = stage(_positions(_with_span(turns, budget, history)))
    # windows sort as their turns do: by longer turns passed, then block, a longer turn last
    rows = rows.withColumn("block", F.floor(F.col("before") / F.col("span"))) \
               .withColumn("window", F.struct("bigs", "big", "block"))
    head = (F.col("at") == 0) & (F.col("role") == "system")
    starts = rows.groupBy("conv", "window").agg(
        F.min("at").alias("window_start"), F.min("before").alias("start"), F.sum("cost").alias("own"),
        F.first("head").alias("head"), F.first("span").alias("span"))
    starts = starts.select("conv", "window", "window_start", "start", F.floor(F.col("start") / F.col("span")).alias("block"),
                           F.least(F.lit(history), "span", F.lit(budget) - F.col("head") - F.col("own")).alias("room"))

    def part(df: DataFrame, new: bool) -> DataFrame:
        return df.select("conv", "window", F.struct("at", F.lit(new).alias("new"), "role", "piece", "cost").alias("t"))

    # a turn can be history of windows that start in its own block or the next one
    past = rows.filter(~head).select("conv", "role", "piece", "cost", "at", "before",
                                     F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    past = past.join(starts, ["conv", "block"]).filter(
        (F.col("at") < F.col("window_start")) & (F.col("start") - F.col("before") <= F.col("room")))
    lead = rows.filter(head).drop("window", "block").join(
        starts.filter("window_start > 0").select("conv", "window"), "conv")
    parts = part(rows, True).unionByName(part(past, False)).unionByName(part(lead, False))
    out = parts.groupBy("conv", "window").agg(F.sort_array(F.collect_list("t")).alias("t"))
    n_tokens = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["cost"])
    out = out.withColumn("sizes", F.transform("t", lambda x: F.length(x["piece"])))

    def before(i: Column) -> Column:
        return F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, n: a + n)

    def under_loss(x: Column, i: Column) -> Column:
        skip = F.length(x["role"]) + len(HEAD) + 1      # "assistant" needs no escape
        return F.struct((before(i) + skip).alias("start"),
                        (F.length(x["piece"]) - skip - len(END) - 1).alias("length"),
                        (x["new"] & (x["role"] == "assistant")).alias("on"))

    spans = F.filter(F.transform("t", under_loss), lambda s: s["on"])
    return out.select(
        F.col("conv.id").alias("conv_id"),
        F.array_min(F.transform(F.filter("t", lambda x: x["new"]), lambda x: x["at"])).alias("window_start"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("text"),
        n_tokens.alias("n_tokens"), (n_tokens > budget).alias("over_budget"),
        F.size(F.filter("t", lambda x: ~x["new"])).alias("repeated"),
        F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows hold, parsed from their text: conv_id, window_start, turns (role and
    text of the new ones), targets (unescaped texts under the loss mask)."""
    pieces = F.split("text", f"{END}\n")
    new = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(unescape(F.substr(role, F.lit(len(HEAD) + 1))).alias("role"),
                        unescape(F.substr(p, F.length(role) + 2)).alias("text"))

    return formatted.select(
        "conv_id", "window_start", "text", F.transform(new, turn).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"]))).alias("targets"))


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, all from the text of its windows.  A digest of a conversation needs
    its turns in one row; nothing before this step does."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n"), F.length("text").cast("long").alias("chars"),
        F.struct("window_start", said.alias("said"), F.array_join("targets", "").alias("targets")).alias("w"))
    got = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                      F.sort_array(F.collect_list("w")).alias("w"))
    targets = F.array_join("w.targets", "")
    return got.select("conv_id", "n_turns", F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"),
                      F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"),
                      "formatted_chars")
