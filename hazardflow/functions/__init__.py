"""Column helpers. All of them are built-in expressions that compose into one projection."""
