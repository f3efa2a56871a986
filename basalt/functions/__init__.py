"""Column builders: URLs, identities, scope, names. All are built-in expressions, so plans stay in the JVM."""
