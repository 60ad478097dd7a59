"""Readers and writers: manifests, JSON-lines offsets, listings, side indexes."""
