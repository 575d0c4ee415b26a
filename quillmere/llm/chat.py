"""Chat formatting into budgeted windows, in DataFrame operations only.

Prefix sums of turn tokens cut each conversation into turn-aligned spans: a span holds the turns that lie between two
multiples of its share of the budget; a turn that crosses a multiple is a span of its own. Each window repeats the
system turn and then the last turns before it, up to ``history`` turns and ``history_tokens`` tokens, as far as the
budget has room beside the span: a large system turn or a long turn leaves less history. So a window keeps within the
budget, unless the system turn and one turn alone are longer; such a window has no history. Only what a window holds
for the first time is a target: every assistant text is under the loss mask once, whichever windows repeat it.

Skew: positions and prefix sums are made in two steps, within blocks of BLOCK turn numbers and over the blocks of a
conversation, so a conversation with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEP, END = "<|turn|>", "<|says|>", "<|over|>\n"
ESCAPE = "\\"
#: Control strings of this and other templates; inside a text each gets ESCAPE behind its first character.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BLOCK = 256
#: Tokens that the marks of a turn count for.
MARKS = 8


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up, and the marks; needs no tokenizer and never undercounts an empty turn."""
    return F.ceil(F.octet_length(text) / 4) + MARKS


def _placed(turns: DataFrame) -> DataFrame:
    """conv, role, text, tokens with pos, start (tokens before it) and the conversation's first row."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    keyed = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    sums = keyed.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.min(F.struct("turn", "role", "text", "tokens")).alias("first"))
    over = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first())
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        F.col("conv").alias("conv_b"),
        F.col("block").alias("block_b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t"),
        F.first("first").over(over.rowsBetween(Window.unboundedPreceding, 0)).alias("head"),
    )
    within = Window.partitionBy("conv", "block").orderBy(*order)
    local = keyed.select(
        "*",
        (F.row_number().over(within) - 1).alias("i"),
        (F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("s"),
    )
    return local.join(base, F.col("conv").eqNullSafe(F.col("conv_b")) & F.col("block").eqNullSafe(F.col("block_b"))).select(
        "conv", "role", "text", "tokens", (F.col("i") + F.col("n")).alias("pos"), (F.col("s") + F.col("t")).alias("start"), "head"
    )


def format_chat(
    conversations: DataFrame,
    budget: int = 2048,
    history: int = 2,
    history_tokens: int = 512,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokens_col: str | None = None,
) -> DataFrame:
    """conv_id, window, text, loss_spans (code points of text, start and end), n_repeated, n_turns: one row a window.

    Null roles and texts are empty ones; a null turn number comes first; rows that share a turn number follow in the
    order of role and text; a null conv_id is a conversation of its own. An empty table gives no rows; other columns
    are not read. Texts are never cut: a turn longer than the budget is a window of its own. tokens_col names a column
    with the tokens of each turn; without it, or where it is null, they are estimated by turn_tokens.
    """
    tokens = turn_tokens(F.coalesce(F.col(text_col), F.lit("")))
    turns = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.coalesce(F.col(tokens_col).cast("long"), tokens) if tokens_col else tokens).alias("tokens"),
    )
    room = F.lit(budget) - F.when(F.col("head.role") == "system", F.col("head.tokens")).otherwise(0)
    # what a span may hold: history gives way first, and spans of less than a quarter of the budget are only made if
    # the system turn leaves no more
    share = F.greatest(room - history_tokens, F.least(room, F.lit(budget // 4)), F.lit(1))
    cell = F.floor(F.col("start") / share)
    crossing = F.floor((F.col("start") + F.col("tokens") - 1) / share) > cell
    placed = _placed(turns).select(
        "conv", "role", "text", "tokens", "pos", (2 * cell + crossing.cast("long")).alias("window"), (F.col("head.role") == "system").alias("has_system"), room.alias("room")
    )
    left = F.least(F.lit(history_tokens), F.first("room") - F.sum("tokens")).alias("left_w")
    spans = placed.groupBy("conv", "window").agg(F.min("pos").alias("from"), F.first("has_system").alias("has_system"), left).where("from > 0")
    back = F.filter(F.transform(F.sequence(F.lit(1), F.lit(max(1, history))), lambda j: F.col("from") - j), lambda p: (p >= F.col("has_system").cast("long")))
    wanted = spans.select(
        F.col("conv").alias("conv_w"),
        F.col("window").alias("window_w"),
        F.explode(F.concat(F.when(F.col("has_system"), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>")), back if history else F.array().cast("array<bigint>"))).alias("pos_w"),
        "has_system",
        "left_w",
    )
    nearest = Window.partitionBy("conv_w", "window_w").orderBy(F.col("pos_w").desc())
    kept_system = F.col("has_system_w") & (F.col("pos_w") == 0)
    repeats = (
        placed.join(wanted.withColumnRenamed("has_system", "has_system_w"), F.col("conv").eqNullSafe(F.col("conv_w")) & (F.col("pos") == F.col("pos_w")))
        .withColumn("far", F.sum("tokens").over(nearest.rowsBetween(Window.unboundedPreceding, 0)))
        .where(kept_system | (F.col("far") <= F.col("left_w")))
        .select("conv", F.col("window_w").alias("window"), "pos", "role", "text", F.lit(True).alias("repeated"))
    )
    parts = placed.select("conv", "window", "pos", "role", "text", F.lit(False).alias("repeated")).unionByName(repeats)
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SEP))
    body = escaped(F.col("text"))
    parts = parts.select(
        "conv",
        "window",
        F.struct("pos", "repeated", F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.length(body)).alias("loss"), F.length(head).alias("head"), F.concat(head, body, F.lit(END)).alias("said")).alias("part"),
    )
    windows = parts.groupBy("conv", "window").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def grown(acc: Column, part: Column) -> Column:
        begin = acc["at"] + part["head"]
        span = F.array(F.struct(begin.alias("start"), (begin + part["loss"]).alias("end")))
        return F.struct((acc["at"] + F.length(part["said"])).alias("at"), F.when(part["loss"].isNotNull(), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return windows.select(
        F.col("conv").alias("conv_id"),
        "window",
        F.array_join(F.col("parts.said"), "").alias("text"),
        F.aggregate("parts", zero, grown)["spans"].alias("loss_spans"),
        F.size(F.filter("parts", lambda p: p["repeated"])).alias("n_repeated"),
        F.size("parts").alias("n_turns"),
    )


def read_chat(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns array<struct<role, text>> without what is repeated, loss array<string>: from format_chat's text."""
    said = F.split(F.col("text"), r"\Q" + END + r"\E", -1)
    fresh = F.slice(said, F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))

    def turn(part: Column) -> Column:
        halves = F.split(part, r"\Q" + SEP + r"\E", 2)
        return F.struct(unescaped(F.substring(halves[0], len(OPEN) + 1, 2**31 - 1)).alias("role"), unescaped(halves[1]).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.select("conv_id", "window", F.transform(fresh, turn).alias("turns"), loss.alias("loss"), F.length("text").cast("long").alias("chars"))


def chat_digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, read back from windows.

    A digest of a whole conversation needs its text in one row; a conversation is the unit here, and nothing larger.
    """
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lines = read_chat(windows).select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", joined.alias("turns"), F.array_join("loss", "").alias("loss")).alias("w"))
    whole = lines.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.sort_array(F.collect_list("w")).alias("w"))
    turns, loss = F.array_join("w.turns", ""), F.array_join("w.loss", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def oracle_sql(source: str, budget: int = 2048, history: int = 2, history_tokens: int = 512) -> str:
    """chat_digests in SQL over a relation with conv_id, turn, role, text."""
    escape = "{}"
    for old, new in [(ESCAPE, ESCAPE * 2), *((m, m[0] + ESCAPE + m[1:]) for m in CONTROL)]:
        escape = f"replace({escape}, '{old}', '{new}')"
    marks = len(OPEN) + len(SEP) + len(END)
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({source})
), a AS (
  SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + {MARKS} AS tokens,
    length({escape.format("role")}) + length({escape.format("text")}) + {marks} AS chars FROM t
), b AS (
  SELECT *, row_number() OVER o - 1 AS pos, sum(tokens) OVER o - tokens AS start, first_value(role) OVER o = 'system' AS sys, first_value(tokens) OVER o AS head
  FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), c AS (
  SELECT *, greatest(room - {history_tokens}, least(room, {budget // 4}), 1) AS share FROM (SELECT *, {budget} - CASE WHEN sys THEN head ELSE 0 END AS room FROM b)
), d AS (
  SELECT *, 2 * (start // share) + CASE WHEN (start + tokens - 1) // share > start // share THEN 1 ELSE 0 END AS win FROM c
), spans AS (
  SELECT conv_id, win, min(pos) AS f, any_value(sys) AS sys, least({history_tokens}, any_value(room) - sum(tokens)) AS room FROM d GROUP BY conv_id, win
), again AS (
  SELECT s.conv_id, s.win, d.pos, d.chars, s.sys, s.room, sum(d.tokens) OVER (PARTITION BY s.conv_id, s.win ORDER BY d.pos DESC) AS far
  FROM spans s JOIN d ON s.conv_id IS NOT DISTINCT FROM d.conv_id AND s.f > 0
    AND ((s.sys AND d.pos = 0) OR (d.pos < s.f AND d.pos >= s.f - {history} AND d.pos >= CASE WHEN s.sys THEN 1 ELSE 0 END))
), extra AS (
  SELECT conv_id, sum(chars) AS chars FROM again WHERE (sys AND pos = 0) OR far <= room GROUP BY 1
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars) AS chars, count(DISTINCT win) AS n_windows
  FROM d GROUP BY conv_id
)
SELECT w.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, CAST(w.chars + coalesce(e.chars, 0) AS BIGINT) AS formatted_chars, n_windows
FROM whole w LEFT JOIN extra e ON w.conv_id IS NOT DISTINCT FROM e.conv_id
"""
