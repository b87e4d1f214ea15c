"""All queries of the engine: name -> (query, SQL or None)."""

from tessella.queries import corpus, micro, rich, tpch, workflow

QUERIES: dict = {**tpch.QUERIES, **micro.QUERIES, **rich.QUERIES, **workflow.QUERIES, **corpus.QUERIES}
