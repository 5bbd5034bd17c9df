"""Column functions: text, hashes and numbers, all as JVM expressions unless they say otherwise."""
