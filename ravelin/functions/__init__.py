"""Column expressions that stay inside the JVM, and the few Arrow functions that can't."""
