"""Readers for capture files and the writers for tidy results."""
