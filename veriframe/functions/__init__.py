"""Column functions; they run inside the JVM."""
