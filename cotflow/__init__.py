"""cotflow: reasoning-graph data processing as Spark jobs."""
