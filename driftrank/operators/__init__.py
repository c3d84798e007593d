"""Operators on edges, degrees, ranks and scans."""
