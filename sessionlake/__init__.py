"""sessionlake: analytics over the activity log of LLM agents, as Spark jobs."""
