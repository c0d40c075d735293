"""Inputs: tables, pages, file listings."""
