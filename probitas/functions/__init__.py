"""Column-expression functions (JVM-side, whole-stage codegen friendly)."""
