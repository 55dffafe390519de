"""Chat formatting in budgeted, turn-aligned windows, with DataFrame expressions only.

Prefix sums of turn tokens choose the spans: a window takes turns while they fit the budget, always at least one, so no turn
is cut or dropped. Later windows begin with the leading system turn, if there is one, and up to two turns of history. Loss
spans (code points of the formatted text) cover the assistant texts that are new in the window; repeated ones are masked.

Turns are marked by control strings. In texts and roles every backslash is doubled and every control string, also of other
common templates, gets a backslash after its first character, so markers stay unique and the text can be restored.

Turns are ordered by turn number (missing ones last), role and text; repeated rows are turns of their own. Null role and
null text count as empty. Rows without conv_id form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import pick

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of common chat templates.
CONTROL = ["<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
BUDGET, HISTORY = 512, 96  # tokens of a window, tokens of repeated history


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return c


def unescape(c: Column) -> Column:
    for s in CONTROL:
        c = F.replace(c, F.lit(f"{s[0]}\\{s[1:]}"), F.lit(s))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def estimated_tokens(text: Column) -> Column:
    """Four characters a token, and four tokens for the markers."""
    return F.ceil(F.length(text) / 4).cast("long") + 4


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=estimated_tokens) -> DataFrame:
    """``conv_id, window, formatted, loss_spans, repeated`` per window of ``turns(conv_id, turn, role, text)``.

    repeated: leading turns of the window that earlier ones hold already.
    """
    rows = pick(turns, "conv_id", "turn", "role", "text")
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")})
    rows = rows.withColumn("tokens", tokens(F.col("text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"rn": F.row_number().over(order), "upto": F.sum("tokens").over(sofar)})
    system = F.when((F.col("rn") == 1) & (F.col("role") == "system"), F.col("tokens")).otherwise(0)
    rows = rows.withColumn("system", F.max(system).over(sofar))
    # History of one or two turns that are not the kept system turn; none where turn and history exceed the budget.
    first = F.when(F.col("system") > 0, 1).otherwise(0)
    one, two = F.lag("tokens", 1).over(order), F.lag("tokens", 2).over(order)
    has_one = (F.col("rn") - 1 > first) & (one <= history)
    has_two = has_one & (F.col("rn") - 2 > first) & (one + two <= history)
    again = F.when(has_two, F.struct(F.lit(2).alias("n"), (one + two).alias("sum"))).when(
        has_one, F.struct(F.lit(1).alias("n"), one.alias("sum"))
    )
    rows = rows.withColumn("again", F.coalesce(again, F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"))))
    fits = F.col("tokens") + F.col("again.sum") + F.col("system") <= budget
    rows = rows.withColumns(
        {
            "back": F.when(fits, F.col("again.n")).otherwise(0),
            "base": F.col("upto") - F.col("tokens") - F.when(fits, F.col("again.sum")).otherwise(0),
        }
    )
    turn = F.struct("rn", "upto", "base", "back", "role", "text")
    convs = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.max("system").alias("system")
    )

    def extend(state: Column, t: Column) -> Column:
        room = F.lit(budget) - F.when(F.size(state["starts"]) > 1, F.col("system")).otherwise(0)
        opens = (F.size(state["starts"]) == 0) | (t["upto"] - state["base"] > room)
        base = F.when(F.size(state["starts"]) == 0, F.lit(0).cast("long")).otherwise(t["base"])
        back = F.when(F.size(state["starts"]) == 0, F.lit(0)).otherwise(t["back"])
        start = F.array(F.struct(t["rn"].alias("rn"), back.alias("back")))
        return F.when(
            opens, F.struct(base.alias("base"), F.concat(state["starts"], start).alias("starts"))
        ).otherwise(state)

    none = F.array().cast("array<struct<rn:int,back:int>>")
    convs = convs.withColumn(
        "starts", F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("base"), none.alias("starts")), extend)["starts"]
    )
    starts, all_turns = F.col("starts"), F.col("turns")
    keeps = (F.col("system") > 0).cast("int")

    def window(s: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1)["rn"], F.size(all_turns) + 1)
        own = F.slice(all_turns, s["rn"] - s["back"], end - s["rn"] + s["back"])
        head = F.slice(all_turns, 1, F.when(i > 0, keeps).otherwise(0))
        repeated = s["back"] + F.when(i > 0, keeps).otherwise(0)
        return F.struct(i.alias("window"), repeated.alias("repeated"), F.concat(head, own).alias("turns"))

    rows = convs.select("conv_id", F.explode(F.transform(starts, window)).alias("w"))
    rows = rows.select("conv_id", F.col("w.window").alias("window"), F.col("w.repeated").alias("repeated"), "w.turns")
    marked = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("head"), escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("target"),
        ),
    )
    rows = rows.withColumn("marked", marked)

    def locate(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        new = t["target"] & (state["seen"] >= F.col("repeated"))
        return F.struct(
            (end + len(END)).alias("at"), (state["seen"] + 1).alias("seen"),
            F.when(new, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    spans = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("seen"), spans.alias("spans"))
    text = F.array_join(F.transform("marked", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return rows.select(
        "conv_id", "window", text.alias("formatted"), F.aggregate("marked", zero, locate)["spans"].alias("loss_spans"),
        "repeated",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and loss texts of windows, from their formatted texts: ``conv_id, window, turns, losses``."""
    pieces = F.split("formatted", "<\\|turn\\|>")
    own = F.slice(pieces, F.col("repeated") + 2, F.size(pieces))
    body = lambda p: F.substring_index(F.substring_index(p, BODY, -1), END, 1)
    turn = lambda p: F.struct(
        unescape(F.substring_index(p, BODY, 1)).alias("role"), unescape(body(p)).alias("text")
    )
    losses = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    return windows.select(
        "conv_id", "window", F.transform(own, turn).alias("turns"), losses.alias("losses"),
        F.length("formatted").cast("long").alias("chars"),
    )


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation: number of turns, digests of turns and loss texts, and formatted characters, as read back."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = read_back(windows).select(
        "conv_id", "chars", F.size("turns").alias("n"),
        F.struct("window", F.array_join(lines, "").alias("turns"), F.array_join("losses", "").alias("losses")).alias("w"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("w")
    )
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    whole = whole.select("conv_id", "n_turns", "formatted_chars", joined("turns").alias("t"), joined("losses").alias("l"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return whole.select(
        "conv_id", "n_turns", sha("t").alias("turns_sha256"), F.length("l").cast("long").alias("loss_chars"),
        sha("l").alias("loss_sha256"), "formatted_chars",
    )
