"""Column-expression building blocks (no shuffles, JVM-side)."""
