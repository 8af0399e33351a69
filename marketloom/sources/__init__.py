"""Readers, writers and the mapping of the driver's tables to the logical model."""
