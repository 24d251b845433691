"""Relational operators of a subset: selection of tables and rows, closure, masking, merging."""
