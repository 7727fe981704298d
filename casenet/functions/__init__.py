"""Column functions: text rules, taxonomies and scalar maps."""
