"""Random-walk analytics on large directed graphs, written against the Spark DataFrame API."""
