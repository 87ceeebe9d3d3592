"""DataFrame operators: joins, aggregations, ranking and text corpus work."""
