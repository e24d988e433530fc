"""Column expressions of the screening domain; all run inside the JVM."""
