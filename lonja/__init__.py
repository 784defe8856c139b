"""lonja: product matching, attribute inference and corpus preparation as Spark jobs."""
