"""Whole queries over tables: domain tables, pipeline levels, and the registered queries."""
