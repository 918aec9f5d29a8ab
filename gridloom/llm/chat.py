"""Chat formatting into budgeted windows. DataFrame functions only.

Turns are cut into turn-aligned spans by prefix sums of their tokens; each span becomes a window that starts with the
system turn, repeats limited history from the span before, and marks what is learnt from: each assistant text in the
window of its own span, and never where it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 192
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """A backslash before each backslash and between the two characters of each control opening."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


#: Letters of scripts that write words without spaces between them.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def token_estimate(text: Column) -> Column:
    """Tokens of a text in any script, and four for the template.

    Pieces of up to eight letters or digits of a word, single letters of unspaced scripts, and single marks count one each.
    """
    return F.regexp_count(text, F.lit(rf"[{UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{UNSPACED}]]{{1,8}}|[^\p{{L}}\p{{M}}\p{{N}}\s]")) + 4


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=token_estimate) -> DataFrame:
    """conv_id, window, text, n_context, loss: the windows of each conversation, numbered from 1.

    turns: conv_id, turn, role, text. Null roles and texts count as empty; null conv_ids are one conversation; equal or
    null turns are ordered (nulls first) by role, then text. A first turn whose role is system opens every window.
    n_context counts the leading turns that are there for context only. loss holds (start, length) in characters of the
    assistant texts to learn from. `tokens` gives a turn's tokens from its text, or names a column of turns that holds
    them, of a tokenizer's own count, say. Of the room that the budget leaves beside the system turn and the history, a
    turn over half is a span of its own; the others share a span if their prefix sums fall into one stretch of the room
    less the conversation's largest such turn. So a window keeps the budget, unless a single turn is beyond it; that turn
    is kept whole.
    """
    by = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before, so_far = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, 0)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = F.coalesce(F.col(tokens), F.lit(0)) if isinstance(tokens, str) else tokens(text)
    df = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), own.cast("bigint").alias("n"))
    df = df.withColumn("i", F.row_number().over(by))
    first_role, first_n = F.first("role").over(so_far), F.first("n").over(so_far)
    df = df.withColumn("system", F.when(first_role == "system", F.first("text").over(so_far)))
    df = df.withColumn("room", F.greatest(F.lit(2), budget - history - F.when(first_role == "system", first_n).otherwise(0)))
    df = df.withColumn("n", F.when((F.col("i") == 1) & F.col("system").isNotNull(), 0).otherwise(F.col("n")))
    df = df.withColumn("big", (F.col("n") > F.col("room") / 2).cast("int"))
    df = df.withColumn("most", F.max(F.when(F.col("big") == 0, F.col("n"))).over(W.partitionBy("conv_id")))
    df = df.withColumn("from", F.coalesce(F.sum("n").over(before), F.lit(0)))
    df = df.withColumn("stretch", F.floor(F.col("from") / (F.col("room") - F.coalesce("most", F.lit(0)))))
    cut = F.coalesce((F.col("stretch") != F.lag("stretch").over(by)) | (F.col("big") == 1) | (F.lag("big").over(by) == 1), F.lit(True))
    df = df.withColumn("cut", (cut & (F.col("i") > 1)).cast("int")).withColumn("span", 1 + F.sum("cut").over(so_far))
    of_span, of_all = W.partitionBy("conv_id", "span"), W.partitionBy("conv_id")
    df = df.withColumn("end", F.max(F.col("from") + F.col("n")).over(of_span)).withColumn("spans", F.max("span").over(of_all))

    def part(window: Column, order: Column, context: bool, role: Column, text: Column) -> Column:
        return F.struct(window.alias("window"), order.alias("i"), F.lit(context).alias("context"), role.alias("role"), text.alias("text"))

    is_system = (F.col("i") == 1) & F.col("system").isNotNull()
    parts = F.array(
        part(F.col("span"), F.col("i"), False, F.col("role"), F.col("text")),
        F.when((F.col("span") < F.col("spans")) & (F.col("end") - F.col("from") <= history) & ~is_system, part(F.col("span") + 1, F.col("i"), True, F.col("role"), F.col("text"))),
        F.when((F.col("cut") == 1) & F.col("system").isNotNull(), part(F.col("span"), F.lit(0), True, F.lit("system"), F.col("system"))),
    )
    df = df.select("conv_id", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p")).select("conv_id", "p.*")
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    df = df.select("conv_id", "window", "i", "context", "role", head.alias("head"), body.alias("body"))
    df = df.withColumn("at", F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(W.partitionBy("conv_id", "window").orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    learnt = F.when((F.col("role") == "assistant") & ~F.col("context"), F.struct((F.col("at") + F.length("head")).cast("int").alias("start"), F.length("body").alias("length")))
    rows = df.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("i", F.concat("head", "body", F.lit(END)).alias("s"), "context", learnt.alias("loss")))).alias("r"))
    return rows.select(
        "conv_id", F.col("window").cast("int").alias("window"), F.array_join("r.s", "").alias("text"),
        F.size(F.filter("r", lambda x: x.context)).alias("n_context"), F.filter("r.loss", lambda x: x.isNotNull()).alias("loss"),
    )


def read_windows(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text), learnt (texts under the loss mask), chars: what the windows hold.

    Turns that are context only are left out, so the windows of a conversation give each of its turns once, in order.
    """
    raw = F.filter(F.split(F.col("text"), F.lit(r"<\|im_start\|>")), lambda s: s != "")
    head = r"^[^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+"

    def turn(s: Column) -> Column:
        role = F.regexp_extract(s, head, 0)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(s, F.length(role) + 2, F.length(s) - F.length(role) - 1 - len(END))).alias("text"))

    own = F.slice(raw, F.col("n_context") + 1, F.greatest(F.size(raw) - F.col("n_context"), F.lit(0)))
    learnt = F.transform("loss", lambda m: unescape(F.substr(F.col("text"), m.start + 1, m.length)))
    return formatted.select("conv_id", "window", F.transform(own, turn).alias("turns"), learnt.alias("learnt"), F.length("text").cast("bigint").alias("chars"))
