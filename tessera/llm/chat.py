"""Chat formatting in token windows, in DataFrame functions only.

A turn becomes ``<|im_start|>role``, a line end, its text and ``<|im_end|>``.
Control strings inside a text get a backslash after their first character (one
more if there are some), so a text can't end a turn and reading takes it out
again. Prefix sums of the turns' tokens choose windows of whole turns: a window
takes turns until the next would exceed the budget. A window that doesn't begin
a conversation repeats the system turn and up to ``HISTORY`` turns before it
that fit in a share of the budget; the loss mask holds the assistant texts of
new turns only, so each is a target once. A turn longer than the budget is a
window of its own, whole.

Scale. One shuffle by conversation; a conversation is one row because its
windows depend on each other. Windows are rows of their own.

Nulls, ties, repeats: a null text or role is empty. Turns are ordered by turn,
then role, then text (nulls first); repeated rows are repeated turns. Rows
without a conversation's id form one conversation with a null id. An empty table
gives no windows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUDGET = 1024
HISTORY = 2
#: Share of the budget that repeated history may take: one in SHARE.
SHARE = 4
#: Characters a token is reckoned to have, and tokens a turn has besides its text.
CHARS, FRAME = 4, 4
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _read_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``(conv_id, window, repeated, text, loss)`` from rows (conv_id, turn, role, text).

    ``repeated`` counts the turns at a window's start that earlier windows hold;
    ``loss`` has the mask's spans (code points, end exclusive).
    """
    said, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(OPEN), _role(role), F.lit("\n"))
    made = turns.select(
        "conv_id",
        F.struct("turn", role.alias("role"), said.alias("text")).alias("order"),
        F.concat(head, escape(said), F.lit(CLOSE)).alias("block"),
        F.length(head).alias("head"),
        F.length(escape(said)).alias("body"),
        (role == "assistant").alias("target"),
        (role == "system").alias("system"),
        (F.ceil(F.length(said) / CHARS) + FRAME).cast("long").alias("tokens"),
    )
    order = Window.partitionBy("conv_id").orderBy("order")
    summed = made.withColumn("nth", F.row_number().over(order)).withColumn("sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the same partitioning serves the grouping
    t = F.sort_array(F.collect_list(F.struct("nth", "sum", "tokens", "block", "head", "body", "target", "system")))
    convs = summed.groupBy("conv_id").agg(t.alias("t"), F.count("*").cast("int").alias("n"))
    has_system = F.col("t")[0]["system"]
    room = F.greatest(F.lit(1).cast("long"), F.lit(budget - budget // SHARE) - F.when(has_system, F.col("t")[0]["tokens"]).otherwise(0))

    def before(i: Column) -> Column:
        return F.get("t", i)["sum"] - F.get("t", i)["tokens"]

    def begin(acc: Column, i: Column) -> Column:
        newest = F.element_at(acc, -1)
        return F.when((i > newest) & (F.get("t", i)["sum"] - before(newest) > room), F.concat(acc, F.array(i))).otherwise(acc)

    convs = convs.select("conv_id", "t", "n", F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.array(F.lit(0)), begin).alias("begins"))

    def bounds(first: Column, k: Column) -> Column:
        lead = F.when(has_system & (first > 0), 1).otherwise(0)
        low = F.greatest(lead, first - history)
        back = F.when(low < first, F.sequence(low, first - 1)).otherwise(F.array().cast("array<int>"))
        fits = F.size(F.filter(back, lambda i: before(first) - before(i) <= budget // SHARE))
        return F.struct(k.alias("window"), lead.alias("lead"), fits.alias("fits"), (first - fits).alias("low"), F.coalesce(F.get("begins", k + 1), F.col("n")).alias("after"))

    def parts(x: Column) -> Column:
        # a window takes its own turns along, not the conversation
        own = F.slice("t", x["low"] + 1, x["after"] - x["low"])
        return F.struct(x["window"].alias("window"), (x["lead"] + x["fits"]).alias("repeated"), F.when(x["lead"] == 1, F.concat(F.slice("t", 1, 1), own)).otherwise(own).alias("own"))

    rows = convs.select("conv_id", F.explode(F.transform(F.transform("begins", bounds), parts)).alias("w")).select("conv_id", "w.*")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("seen"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def mark(acc: Column, x: Column) -> Column:
        begins = acc["at"] + x["head"]
        span = F.array(F.struct(begins.alias("start"), (begins + x["body"]).alias("end")))
        loss = F.when(x["target"] & (acc["seen"] >= F.col("repeated")), F.concat(acc["loss"], span)).otherwise(acc["loss"])
        return F.struct((acc["at"] + F.length(x["block"])).alias("at"), (acc["seen"] + 1).alias("seen"), loss.alias("loss"))

    return rows.select("conv_id", "window", "repeated", F.array_join(F.transform("own", lambda x: x["block"]), "").alias("text"), F.aggregate("own", start, mark)["loss"].alias("loss"))


def read(formatted: DataFrame) -> DataFrame:
    """Windows with what their text says: ``turns`` (role, text) that are new in it, and ``loss_text`` under the mask."""
    blocks = F.slice(F.split("text", r"<\|im_start\|>"), 2, 1 << 30)
    new = F.slice(blocks, F.col("repeated") + 1, F.lit(1 << 30))

    def parsed(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = block.substr(F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(CLOSE))
        return F.struct(_read_role(role).alias("role"), unescape(body).alias("text"))

    under = F.transform("loss", lambda s: unescape(F.substring("text", s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("*", F.transform(new, parsed).alias("turns"), F.array_join(under, "").alias("loss_text"))
