"""triplane: knowledge-graph queries and graph-dataset processing as lazy PySpark plans."""
