"""Star-schema analytics on Spark: strict CSV load, star build, checks, publish and analyses."""
