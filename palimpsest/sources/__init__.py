"""Readers of source files as block rows, and writers of tables and documents."""
