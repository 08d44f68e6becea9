"""tracequill: audit analytics for LLM agents, written as Spark DataFrame jobs."""
