"""Column expressions and Arrow functions over document text and vectors."""
