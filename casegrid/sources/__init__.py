"""Readers and writers of the Bronze, Silver, Gold and state tables."""
