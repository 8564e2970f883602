"""Registered queries (one per operator) and end-to-end workflows."""
