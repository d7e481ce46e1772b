"""Operators for training-data preparation: near and exact copies, scans, filters, packing."""
