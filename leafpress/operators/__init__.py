"""Operators over pages, caches, searches and their usage."""
