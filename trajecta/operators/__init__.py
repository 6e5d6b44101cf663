"""DataFrame operators: structure, sequences, lookups, sampling, statistics."""
