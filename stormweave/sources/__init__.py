"""Feed mappings onto the canonical report, image hashing, table sinks and exports."""
