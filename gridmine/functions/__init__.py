"""Column-level functions, evaluated inside the JVM unless a docstring says otherwise."""
