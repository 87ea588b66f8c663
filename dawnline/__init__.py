"""Batch and streaming jobs over large collections of pages, feeds and reports, and operators for training text."""
