"""Column helpers. Everything here stays inside the JVM (no Python UDF)."""
