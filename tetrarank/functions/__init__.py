"""Column expressions: Column in, Column out; all of them stay inside the JVM."""
