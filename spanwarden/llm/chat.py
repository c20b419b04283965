"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns of a conversation are ordered by turn number (then role, then text; null first), and every turn
has a cost in tokens (words and marks). Prefix sums of the costs choose the windows: with the budget
B, the history allowance H and the system turn's cost s, a window takes the turns whose prefix sum
starts in one cell of width S = (B - H - s) / 2. A turn that costs more than S is a window by itself.
So turns never split, and a window holds at most B unless one turn alone (or the system turn) costs
more, in which case the window says so. Nothing is greedy: a turn's window follows from its own prefix
sum, and these sums run in two levels over blocks of turns, so a conversation that holds a third of
all rows is dealt over many tasks and no conversation is collected. A block is a range of turn numbers:
turns of one conversation that have the same number, or none, are ordered in one task.

Each window repeats the conversation's system turn (its first turn, if of role system) and as many
turns before it as H holds; repeated turns are marked and masked. The loss mask covers the text of
assistant turns, each once over all windows.

Template: ``<s>role[INST]text[/INST]</s>`` a turn. Control strings inside texts and roles are
broken up by a backslash after their first character (runs of backslashes there grow by one), which
``unescape`` takes back: no control string of the template ever stands inside a text.

Defined cases: null roles and texts are empty; null conversation ids form one conversation; repeated
turns all stand; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import WORD
from .workspace import Workspace

BUDGET = 2048
HISTORY = 256
TURN_COST = 4
BLOCK = 256
SALTS = 16

OPEN, MID, CLOSE = "<s>", "[INST]", "[/INST]</s>"
#: The control strings of the template and of its family.
CONTROL = r"/?s>|<SYS>>|</SYS>>|/?INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={CONTROL})", r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={CONTROL})", "$1$2")


def cost(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long") + TURN_COST


def placed_turns(ws: Workspace, turns: DataFrame) -> DataFrame:
    """conv, block, turn, role, text, cost, at (place in the conversation), start (prefix sum)."""
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("cost", cost(F.col("text"))).withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK).cast("long"))
    order = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order).cast("long")).withColumn("sum", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = ws.save(rows, "turns")
    blocks = rows.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("b_n"), F.sum("cost").alias("b_cost"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("b_n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("b_cost").over(before), F.lit(0)).alias("cost_before"))
    joined = rows.join(blocks, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.select("conv", "block", "turn", "role", "text", "cost", (F.col("n_before") + F.col("n") - 1).alias("at"), (F.col("cost_before") + F.col("sum") - F.col("cost")).alias("start"))


def windows(spark: SparkSession, turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window (its first turn's place), formatted, turns (place, repeated),
    loss (start and end of every span under the loss mask, in code points), tokens, over_budget."""
    ws = Workspace(spark, "chat")
    rows = ws.save(placed_turns(ws, turns), "placed")
    system = rows.filter("at = 0 and role = 'system'").select(F.col("conv").alias("c"), F.col("cost").alias("sys_cost"), F.col("role").alias("sys_role"), F.col("text").alias("sys_text"))
    # a conversation may hold a third of all turns: its system turn meets them in SALTS parts
    system = system.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
    costs = dealt.join(system.select("c", "s", "sys_cost").hint("merge"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("salt") == F.col("s")), "left").drop("c", "s", "salt")
    costs = costs.withColumn("sys_cost", F.coalesce("sys_cost", F.lit(0)))
    costs = costs.withColumn("width", F.greatest(F.lit(max(1, budget // 8)).cast("long"), F.floor((budget - history - F.col("sys_cost")) / 2)))
    # a large turn stands alone, so it parts the turns before it from those behind it in its cell
    costs = costs.withColumn("large", F.col("cost") > F.col("width")).withColumn("cell", F.floor(F.col("start") / F.col("width")))
    in_cell = Window.partitionBy("conv", "cell").orderBy("at")
    larges = F.sum(F.col("large").cast("int")).over(in_cell.rowsBetween(Window.unboundedPreceding, 0))
    costs = costs.withColumn("run", 2 * larges - F.col("large").cast("int"))
    first = Window.partitionBy("conv", "cell", "run")
    costs = ws.save(costs.withColumn("window", F.min("at").over(first)).withColumn("w_start", F.min("start").over(first)), "windowed")

    own = costs.select("conv", "window", "at", "role", "text", "cost", F.lit(False).alias("repeated"))
    heads = costs.select("conv", "window", "w_start", "width", "sys_cost").filter("at = window")
    # history: a turn is repeated by windows that start within the allowance behind its own start, which
    # lie in its cell or the next
    allowance = F.least(F.lit(history).cast("long"), F.col("width"))
    tails = costs.select(F.col("conv").alias("c"), "at", "role", "text", "cost", "start", F.col("window").alias("of"), F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("near"), (F.col("sys_cost") > 0).alias("has_sys"))
    heads = heads.withColumn("w_cell", F.floor(F.col("w_start") / F.col("width")))
    past = heads.join(tails, F.col("conv").eqNullSafe(F.col("c")) & (F.col("w_cell") == F.col("near")))
    past = past.filter((F.col("of") < F.col("window")) & (F.col("start") >= F.col("w_start") - allowance) & ~(F.col("has_sys") & (F.col("at") == 0)))
    past = past.select("conv", "window", "at", "role", "text", "cost", F.lit(True).alias("repeated"))
    leads = heads.filter("window > 0").select("conv", "window").withColumn("salt", F.pmod(F.xxhash64("window"), F.lit(SALTS)).cast("int"))
    lead = leads.join(system.hint("merge"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("salt") == F.col("s"))).select("conv", "window", F.lit(0).cast("long").alias("at"), F.col("sys_role").alias("role"), F.col("sys_text").alias("text"), F.col("sys_cost").alias("cost"), F.lit(True).alias("repeated"))

    parts = own.unionByName(past).unionByName(lead)
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID))
    body = escape(F.col("text"))
    parts = parts.withColumn("head", head).withColumn("body", body)
    loss = (F.col("role") == "assistant") & ~F.col("repeated")
    item = F.struct("at", "repeated", loss.alias("loss"), F.length("head").alias("head_n"), F.length("body").alias("body_n"), F.concat("head", "body", F.lit(CLOSE)).alias("shown"))
    each = parts.groupBy("conv", "window").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("cost").alias("tokens"))
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["n"] + x["head_n"]
        hi = lo + x["body_n"]
        span = F.struct(lo.cast("long").alias("start"), hi.cast("long").alias("end"))
        return F.struct((hi + len(CLOSE)).cast("long").alias("n"), F.when(x["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return each.select(
        F.col("conv").alias("conv_id"),
        "window",
        F.array_join(F.transform("items", lambda x: x["shown"]), "").alias("formatted"),
        F.transform("items", lambda x: F.struct(x["at"].alias("at"), x["repeated"].alias("repeated"))).alias("turns"),
        F.aggregate("items", begin, step)["spans"].alias("loss"),
        "tokens",
        (F.col("tokens") > budget).alias("over_budget"),
    )


def parsed(formatted: Column) -> Column:
    """role and text of every turn of a formatted window, unescaped."""
    turns = F.slice(F.split(formatted, r"\[/INST\]</s>"), 1, F.greatest(F.lit(0), F.size(F.split(formatted, r"\[/INST\]</s>")) - 1))
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), MID, 1)).alias("role"), unescape(F.substr(t, F.instr(t, MID) + len(MID))).alias("text")))


def read_back(shown: DataFrame) -> DataFrame:
    """Digests of whole conversations from their windows: turns that are not repeated and the text under
    the loss mask, in order. A digest of a conversation needs its text in one row."""
    each = shown.select(
        "conv_id",
        "window",
        F.length("formatted").alias("chars"),
        F.filter(F.arrays_zip(parsed(F.col("formatted")).alias("p"), F.col("turns").alias("t")), lambda x: ~x["t"]["repeated"]).alias("own"),
        F.array_join(F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "").alias("loss_text"),
    )
    each = each.select("conv_id", "window", "chars", F.size("own").alias("n"), F.array_join(F.transform("own", lambda x: F.concat(x["p"]["role"], F.lit("\n"), x["p"]["text"], F.lit("\n"))), "").alias("said"), "loss_text")
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "loss_text"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    said, loss = F.array_join("w.said", ""), F.array_join("w.loss_text", "")
    whole = whole.select("conv_id", "n_turns", said.alias("said"), loss.alias("loss"), "formatted_chars")
    return whole.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
