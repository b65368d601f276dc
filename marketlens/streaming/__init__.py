"""Incremental loads of the as-of snapshots, in batch and as a stream."""
