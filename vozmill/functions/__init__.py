"""Column functions: each takes and returns a Column and stays on the JVM."""
