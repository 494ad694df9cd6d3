"""Training-data operators: each module has one operator and the query that applies it to its whole table."""
