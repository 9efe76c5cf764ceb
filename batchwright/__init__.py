"""Batch mutation with per-row failure isolation, expressed as DataFrame plans."""
