"""Operators over runs, indexes, judgements and samples, as DataFrame to DataFrame functions."""
