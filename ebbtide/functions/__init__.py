"""Column expressions, all JVM-side."""
