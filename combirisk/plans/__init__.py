"""Registered queries over the generated tables, each with its SQL check."""
