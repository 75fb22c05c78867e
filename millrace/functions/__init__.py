"""Column expressions and Arrow UDFs used inside the operators."""
