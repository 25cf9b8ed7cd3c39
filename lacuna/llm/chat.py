"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role become one block (array functions over the sorted array); blocks are
concatenated. A block is::

    ### role:
    text<+>text</turn>

Inside roles and texts ``\\`` is written ``\\b``, ``<`` is ``\\l`` and ``#`` is
``\\h`` (in roles a line feed is ``\\n`` too), so that no text can hold a mark,
and reading back is exact. The loss mask is run-length coded, one run for each
turn: ``skip`` characters without loss, then ``take`` characters with it.

Cases: a null text or role counts as empty; null turn numbers sort first; turns
with equal numbers are ordered by role, then text; rows with a null
conversation key form one conversation; repeated rows are repeated turns;
further columns are not read; an empty table gives an empty result. A
conversation becomes one row, so one conversation has to fit into a task: that
is what the result is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, HEAD_END, AGAIN, END = "### ", ":\n", "<+>", "</turn>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    for plain, mark in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    for plain, mark in (("#", "\\h"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chats(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (an array of skip and take)."""
    rows = turns.select(
        F.col(f"`{key}`").alias("conv_id"),
        F.struct(
            F.col(f"`{order}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("one"),
    )
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("raw"))
    marked = sorted_.select(
        "conv_id",
        F.transform("raw", lambda x: F.struct(x.role.alias("plain"), escape_role(x.role).alias("role"), escape(x.text).alias("text"))).alias("turns"),
    )
    # Where each block of adjacent turns of one role starts, from 0.
    starts = marked.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])),
    )
    blocks = starts.withColumn(
        "blocks",
        F.transform("starts", lambda s, j: F.slice("turns", s + 1, F.coalesce(F.get("starts", j + 1), F.size("turns")) - s)),
    )
    rendered = F.transform(
        "blocks",
        lambda b: F.concat(F.lit(HEAD), F.get(b, F.lit(0))["role"], F.lit(HEAD_END), F.array_join(F.transform(b, lambda x: x.text), AGAIN), F.lit(END)),
    )

    def run(x: Column, i: Column) -> Column:
        first = (i == 0) | (x.role != F.get("turns", i - 1)["role"])
        head = F.when(i > 0, F.lit(len(END))).otherwise(0) + len(HEAD) + F.char_length(x.role) + len(HEAD_END)
        skip = F.when(first, head).otherwise(len(AGAIN)).cast("long")
        size = F.char_length(x.text).cast("long")
        learned = x.plain == LEARNED
        return F.struct(F.when(learned, skip).otherwise(skip + size).alias("skip"), F.when(learned, size).otherwise(F.lit(0).cast("long")).alias("take"))

    return blocks.select("conv_id", F.array_join(rendered, "").alias("formatted"), F.transform("turns", run).alias("loss_mask"))


def under_mask(mask: Column, formatted: Column) -> Column:
    """The stretches of a formatted text that a mask takes, at its running offsets."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,take:bigint>>").alias("runs"))
    add = lambda a, x: F.struct((a["at"] + x["skip"] + x["take"]).alias("at"), F.concat(a["runs"], F.array(F.struct((a["at"] + x["skip"]).alias("start"), x["take"].alias("take")))).alias("runs"))
    return F.transform(F.aggregate(mask, empty, add, lambda a: a["runs"]), lambda r: F.substring(formatted, (r["start"] + 1).cast("int"), r["take"].cast("int")))


def read_back(chats: DataFrame) -> DataFrame:
    """Parse formatted conversations: conv_id, formatted, loss_mask, turns (role, text), learned (the texts under the mask).

    What the mask takes is found by its running offsets in ``formatted``. Where
    each run starts at a text that was parsed there and goes no further, the
    text itself is cut, which takes one pass; else ``formatted`` is.
    """
    blocks = chats.withColumn("parts", F.split("formatted", END)).withColumn("parts", F.slice("parts", F.lit(1), F.size("parts") - 1))

    def opened(block: Column, i: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = F.substring(head, F.lit(len(HEAD) + 1), F.char_length(head) - len(HEAD) - 1)
        body = F.substring(block, F.char_length(head) + 2, F.char_length(block))
        # Characters between the text before and this one.
        lead = F.when(i == 0, 0).otherwise(len(END)) + F.char_length(head) + 1
        return F.transform(F.split(body, "<\\+>"), lambda t, j: F.struct(role.alias("role"), t.alias("text"), F.when(j == 0, lead).otherwise(len(AGAIN)).cast("long").alias("lead")))

    found = blocks.withColumn("found", F.flatten(F.transform("parts", opened)))
    both = F.zip_with("loss_mask", "found", lambda m, t: F.struct(m["skip"].alias("skip"), m["take"].alias("take"), t["lead"].alias("lead"), F.char_length(t["text"]).cast("long").alias("size")))
    start = F.struct(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("text"), (F.size("loss_mask") == F.size("found")).alias("fits"))

    def step(a: Column, x: Column) -> Column:
        on = (x["take"] == 0) | ((a["mask"] + x["skip"] == a["text"] + x["lead"]) & (x["take"] <= x["size"]))
        return F.struct((a["mask"] + x["skip"] + x["take"]).alias("mask"), (a["text"] + x["lead"] + x["size"]).alias("text"), (a["fits"] & F.coalesce(on, F.lit(False))).alias("fits"))

    fits = F.aggregate(both, start, step, lambda a: a["fits"])
    at_texts = F.zip_with("loss_mask", "found", lambda m, t: F.substring(t["text"], F.lit(1), m["take"].cast("int")))
    learned = F.when(fits, at_texts).otherwise(under_mask(F.col("loss_mask"), F.col("formatted")))
    turn = lambda x: F.struct(unescape_role(x["role"]).alias("role"), unescape(x["text"]).alias("text"))
    return found.select("conv_id", "formatted", "loss_mask", F.transform("found", turn).alias("turns"), F.transform(learned, unescape).alias("learned"))


def digests(chats: DataFrame) -> DataFrame:
    """What was read back, as counts and digests; ``mask_fits``: the mask covers the text to its last end mark."""
    read = read_back(chats).select(
        "conv_id",
        "loss_mask",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("all"),
        F.array_join("learned", "").alias("learned"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    covered = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, x: a + x["skip"] + x["take"])
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("all", 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
        (covered + len(END) == F.col("formatted_chars")).alias("mask_fits"),
    )


#: DuckDB SQL for the registered query, over the table and conversation -7.
ORACLE = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS pos,
         replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS etext,
         replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), chr(10), '\n') AS erole
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
       CAST(sum(length(etext) + CASE WHEN before IS DISTINCT FROM role THEN 14 + length(erole) ELSE 3 END) AS BIGINT) AS formatted_chars,
       true AS mask_fits
FROM marked GROUP BY conv_id
"""
