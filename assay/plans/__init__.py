"""How many statistics become few Spark jobs."""
