"""Query of the cross-tokenizer alignment."""

from lotweave.llm import alignment
from lotweave.llm.registry import query, table


@query("op13_tokenizer_alignment")
def op13(spark, folder):
    return alignment.align(table(spark, folder, "documents"))
