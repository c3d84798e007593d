"""Sliding windows, push, power iteration, and the engine that joins them."""
