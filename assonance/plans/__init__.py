"""Plan-level helpers: durable lineage cuts, size-checked joins, graph components."""
