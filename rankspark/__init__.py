"""rankspark: pair scoring, ranking evaluation and corpus preparation as Spark jobs."""
