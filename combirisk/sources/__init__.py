"""Readers and writers for the interaction, graph and external tables."""
