"""DataFrame-to-DataFrame operators of the retrieval engine."""
