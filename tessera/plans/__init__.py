"""Plans as data: a tree of relational nodes, compiled to a DataFrame."""
