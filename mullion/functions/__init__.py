"""Column expressions: paths, record fields, texts and hashes."""
