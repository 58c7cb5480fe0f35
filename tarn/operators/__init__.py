"""Operators over records, schemas, notes, links and tasks."""
