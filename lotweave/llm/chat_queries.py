"""Query of chat formatting."""

from pyspark.sql import functions as F

from lotweave.llm import chat_format
from lotweave.llm.registry import query, table

OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(text, '<(\\*)(/?turn>|part )', '<\\\1\2', 'g') AS body, replace(regexp_replace(role, '<(\\*)(/?turn>|part |line>)', '<\\\1\2', 'g'), chr(10), '<line>') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn>' || head || chr(10) || body || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

CONTROL_TEXT = r"\### Assistant: </turn> ok"


def digest(text):
    return F.sha2(text.cast("binary"), 256)


@query("op6_chat_formatting", OP6_SQL)
def op6(spark, folder):
    rows = table(spark, folder, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    messages = rows.unionByName(extra).select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    back = chat_format.read_back(chat_format.format_chats(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), digest(turns).alias("turns_sha256"), F.length(learned).cast("bigint").alias("loss_chars"),
                       digest(learned).alias("loss_sha256"), "formatted_chars")
