"""Chat formatting in budgeted windows of turns, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window and of the turns before its new ones that it repeats; a token stands for
#: CHARS characters of formatted text.
BUDGET, HISTORY, CHARS = 1024, 256, 4
#: Tokens by which windows advance at least, whatever the system turn takes.
LEAST_STRIDE = 64
END = "<|end|>\n"


def escape(text: Column) -> Column:
    """No control string of this or a similar template survives: they all begin with < or [."""
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Training windows of conversations: conv_id, window, text, n_context, loss.

    turns: conv_id, turn, role, text. Turns of a conversation stand in the order of turn, then role and
    text. Each is formatted as <|role|>, a line break, the escaped text and the end mark. The prefix sum
    of the tokens before a turn tells its window: a window takes the turns that begin in its stretch of
    half of what budget leaves beside history and system turn, so it stays within the budget unless a
    single turn is longer than that stretch. Before its new turns it repeats the system turn (a first
    turn of the role system) and the last turns of up to `history` tokens; n_context counts both. loss:
    start and end (code points) of the texts of new assistant turns, so each is learnt from once.

    Null role or text is the empty string. A null conv_id is a conversation of its own, a null turn comes
    first. Repeated rows are turns of their own. Other columns are ignored; an empty table gives an
    empty result. No turn is cut, whatever its length.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    head = F.concat(F.lit("<|"), F.replace(escape(F.col("role")), F.lit("|"), F.lit("&#124;")), F.lit("|>\n"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = rows.withColumn("head", head).withColumn("body", escape(F.col("text")))
    made = made.withColumn("block", F.concat("head", "body", F.lit(END)))
    made = made.withColumn("cost", F.ceil(F.length("block") / F.lit(CHARS)))
    made = (
        made.withColumn("nth", F.row_number().over(order))
        .withColumn("start", F.sum("cost").over(so_far) - F.col("cost"))
        .withColumn("system", F.first(F.when(F.col("role") == "system", F.col("block"))).over(so_far))
    )
    free = F.lit(budget - history) - F.coalesce(F.ceil(F.length("system") / F.lit(CHARS)), F.lit(0))
    made = made.withColumn("stride", F.greatest(F.lit(LEAST_STRIDE).cast("long"), F.floor(free / F.lit(2)).cast("long")))
    made = made.withColumn("own", F.floor(F.col("start") / F.col("stride")))
    reach = F.floor((F.col("start") + F.lit(history)) / F.col("stride"))
    dealt = made.select(
        "conv_id", "nth", "start", "own", "system", "block",
        F.length("head").alias("skip"), F.length("body").alias("size"), (F.col("role") == "assistant").alias("learn"),
        F.explode(F.sequence("own", reach)).alias("window"),
    )
    member = F.struct("nth", "start", (F.col("own") == F.col("window")).alias("new"), "block", "skip", "size", "learn")
    grouped = dealt.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(member)).alias("members"), F.first("system").alias("system")
    )
    grouped = grouped.where(F.exists("members", lambda x: x["new"]))
    begin = F.array_min(F.transform(F.filter("members", lambda x: x["new"]), lambda x: x["start"]))
    grouped = grouped.withColumn("begin", begin).withColumn(
        "members", F.filter("members", lambda x: x["new"] | (F.col("begin") - x["start"] <= F.lit(history)))
    )
    repeat = F.col("system").isNotNull() & (F.element_at("members", 1)["nth"] > 1)
    lead = F.when(repeat, F.col("system")).otherwise(F.lit(""))
    nothing = F.array().cast("array<struct<start: int, end: int>>")

    def learnt(state: Column, x: Column) -> Column:
        first = state["at"] + x["skip"]
        span = F.array(F.struct(first.alias("start"), (first + x["size"]).alias("end")))
        spans = F.when(x["new"] & x["learn"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(x["block"])).alias("at"), spans.alias("spans"))

    empty = F.struct(F.length(lead).alias("at"), nothing.alias("spans"))
    return grouped.select(
        "conv_id",
        "window",
        F.concat(lead, F.concat_ws("", F.transform("members", lambda x: x["block"]))).alias("text"),
        (F.size(F.filter("members", lambda x: ~x["new"])) + repeat.cast("int")).alias("n_context"),
        F.aggregate("members", empty, learnt, lambda s: s["spans"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text: the new turns alone) and loss_text of windows()."""
    blocks = F.slice(F.split("text", r"<\|end\|>\n"), F.col("n_context") + 1, F.size(F.split("text", r"<\|end\|>\n")))
    blocks = F.filter(blocks, lambda x: x != "")

    def turn(block: Column) -> Column:
        cut = F.instr(block, "|>\n")
        role = F.replace(F.substring(block, F.lit(3), cut - F.lit(3)), F.lit("&#124;"), F.lit("|"))
        return F.struct(
            unescape(role).alias("role"), unescape(F.substring(block, cut + F.lit(3), F.length(block))).alias("text")
        )

    pieces = F.transform("loss", lambda x: F.substring(F.col("text"), x["start"] + F.lit(1), x["end"] - x["start"]))
    return formatted.select(
        "conv_id", "window", F.length("text").cast("long").alias("chars"),
        F.transform(blocks, turn).alias("turns"), unescape(F.concat_ws("", pieces)).alias("loss_text"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from windows()."""
    parts = read_back(formatted)
    lines = F.concat_ws(
        "", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    )
    part = F.struct("window", lines.alias("lines"), "loss_text")
    grouped = parts.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.sum("chars").alias("formatted_chars"),
    )
    joined = lambda name: F.concat_ws("", F.transform("parts", lambda p: p[name]))
    return grouped.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("lines"), 256).alias("turns_sha256"),
        F.length(joined("loss_text")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The conversation that the query adds: texts that look like another template's control strings.
EXTRA = "</s>[INST] ok [/INST]"

DIGESTS_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{EXTRA}' UNION ALL SELECT -1, 1, 'assistant', '{EXTRA}'),
sized AS (SELECT *, row_number() OVER o AS nth,
  length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;'))
  + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + {5 + len(END)} AS chars
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
placed AS (SELECT *, ceil(chars / {CHARS}.0)::BIGINT AS cost, first_value(CASE WHEN role = 'system' THEN chars END) OVER o AS system
  FROM sized WINDOW o AS (PARTITION BY conv_id ORDER BY nth)),
summed AS (SELECT *, (sum(cost) OVER o)::BIGINT - cost AS start,
  greatest({LEAST_STRIDE}, floor(({BUDGET - HISTORY} - coalesce(ceil(system / {CHARS}.0), 0)) / 2)::BIGINT) AS stride
  FROM placed WINDOW o AS (PARTITION BY conv_id ORDER BY nth)),
owned AS (SELECT *, start // stride AS own FROM summed),
win AS (SELECT conv_id, own, min(start) AS begin, any_value(system) AS system FROM owned GROUP BY conv_id, own),
repeated AS (SELECT w.conv_id, sum(t.chars) AS chars FROM win w JOIN owned t
  ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.own < w.own AND w.begin - t.start <= {HISTORY} GROUP BY w.conv_id),
systems AS (SELECT conv_id, sum(system) AS chars FROM win WHERE own > 0 AND begin > {HISTORY} GROUP BY conv_id)
SELECT o.conv_id, count(*) AS n_turns,
  sha256(string_agg(o.role || chr(10) || o.text || chr(10), '' ORDER BY o.nth)) AS turns_sha256,
  coalesce(sum(length(o.text)) FILTER (o.role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(o.text, '' ORDER BY o.nth) FILTER (o.role = 'assistant'), '')) AS loss_sha256,
  (sum(o.chars) + coalesce(any_value(r.chars), 0) + coalesce(any_value(s.chars), 0))::BIGINT AS formatted_chars
FROM owned o LEFT JOIN repeated r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
LEFT JOIN systems s ON o.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY o.conv_id
"""
