"""Readers and writers. Parquet is the working format; the others are adapters at the edges."""
