"""Queries by name with the SQL that checks them."""
