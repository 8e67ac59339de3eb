"""Queries over the sample tables, a module for each topic."""
