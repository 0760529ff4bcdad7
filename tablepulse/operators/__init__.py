"""DataFrame operators: relational parts, schema, layers, quality, drift, cost, healing."""
