"""Operators for building text corpora: scans, archives, duplicates, packing, filters, mixing."""
