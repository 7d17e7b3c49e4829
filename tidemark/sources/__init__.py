"""Readers and writers: landed payloads, segments, metrics, fixtures, partitioned tables."""
