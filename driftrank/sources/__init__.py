"""Readers and writers of edge streams, vertex lists and logs."""
