"""Adapters that turn raw captures (files, feeds, PDF text runs, result pages, event streams) into rows."""
