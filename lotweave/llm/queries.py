"""All queries of the subpackage."""

from lotweave.llm import alignment_queries, chat_queries, corpus_queries, dedup_queries, vector_queries, web_queries  # noqa: F401
from lotweave.llm.registry import ORACLES, QUERIES  # noqa: F401
