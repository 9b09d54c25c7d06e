"""Registered queries with their SQL twins, and multi-step programs."""
