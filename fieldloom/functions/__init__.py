"""Column expressions: rounding, quantising, hashing, parsing, labels and question texts."""
