"""Expressions."""
