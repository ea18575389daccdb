"""Column functions: sequences, digests, seeded ranks and text checks."""
