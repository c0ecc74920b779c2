"""Catalog and storage of databases."""
