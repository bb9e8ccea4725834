"""wicketlake: ball-by-ball match analytics as lazy Spark DataFrame jobs.

Layout
------
sources    readers, adapter views over the driver tables, sinks, schemas
functions  Column-level expressions (parsing, labels, scores)
operators  relational building blocks: filters, joins, aggregates, windows,
           top-k, set operations, quality checks, team selection
plans      multi-step jobs (silver/gold layers) and the query registry
streaming  Structured Streaming views of the live event feed
ml         feature matrices and MLlib jobs
retrieval  document building and top-k vector search
"""

__all__ = ["session"]
