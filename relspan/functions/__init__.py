"""The expression language, its functions, and aggregate specs."""
