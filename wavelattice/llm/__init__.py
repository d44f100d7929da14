"""Operators for training text: digests, packing, leak search, reading level.

Nothing outside this folder imports it.
"""
