"""Table operators: joins, aggregations, windows, upserts."""
