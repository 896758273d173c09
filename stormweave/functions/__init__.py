"""Column expressions: text, time, identity and spatial."""
