"""Collections, pipelines and the rewrites made before Spark sees a plan."""
