"""Readers: OOXML archives, text files, cells made from tables, rule files."""
