"""DataFrame operators: parsers, graph, traversal, changes, rules, scores, views."""
