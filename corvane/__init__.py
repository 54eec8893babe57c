"""A Spark-first engine for studying planted cues in model rollouts."""
