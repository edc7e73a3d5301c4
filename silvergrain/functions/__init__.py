"""Column functions: text, vectors, identifiers, relations. All are Spark expressions unless their names say otherwise."""
