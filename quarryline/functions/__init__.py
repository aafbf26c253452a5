"""Column expressions: text, path and hash helpers that stay in the JVM."""
