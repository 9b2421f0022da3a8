"""Queries by area; importing a module registers its queries."""
