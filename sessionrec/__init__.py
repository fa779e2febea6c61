"""sessionrec: session-event retrieval and ranking features as Spark DataFrame jobs."""
