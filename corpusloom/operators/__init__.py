"""DataFrame operators: search, graph, freshness, sync, catalog and report plans."""
