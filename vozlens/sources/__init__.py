"""Readers and writers: corpora by split, JSON lines, CSV, windows with provenance, footers."""
