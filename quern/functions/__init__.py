"""Scalar semantics: wrapping arithmetic, built-in functions and text formats, as JVM-side columns."""
