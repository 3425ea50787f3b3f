"""Readers, writers and the binding of star-schema tables to the catalogue model."""
