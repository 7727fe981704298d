"""DataFrame operators: validation, layout, extraction, resolution, graph, reports."""
