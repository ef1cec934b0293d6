"""DataFrame operators; batch and, where Spark allows it, streaming."""
