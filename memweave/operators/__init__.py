"""DataFrame operators of the memory model: access, retrieval, ingest, resolution, graph, constraints and tiers."""
