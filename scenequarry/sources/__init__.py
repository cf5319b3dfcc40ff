"""Readers and writers of annotation formats."""
