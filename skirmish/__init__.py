"""Team-outcome analytics and training-text preparation as Spark jobs."""
