"""DataFrame operators: each takes a DataFrame and columns, and lazily returns a small tidy DataFrame."""
