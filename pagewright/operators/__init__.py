"""Operators on tables of pages."""
