"""Frame-session analytics on Spark: operators, sources, functions, plans and streams."""
