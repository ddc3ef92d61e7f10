"""A PySpark engine that enumerates good drawings of complete bipartite graphs and analyses them."""
