"""Metadata, routing and the plan of a whole profile."""
