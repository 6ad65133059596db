"""Registered queries by family; importing a module registers its queries."""
