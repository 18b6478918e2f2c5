"""Operators of folioforge."""
