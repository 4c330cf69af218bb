"""Operators composed into whole queries."""
