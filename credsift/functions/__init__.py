"""Column functions: text normal forms, keys, decoding and entropy."""
