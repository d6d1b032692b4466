"""Readers and writers: raw stores, corpus files, exports."""
