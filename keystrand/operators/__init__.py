"""Operators over ordered key/record databases."""
