"""Operators for building training corpora: archives, media, de-duplication, filtering, packing."""
