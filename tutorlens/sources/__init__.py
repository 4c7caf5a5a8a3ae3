"""Readers, adapters and the snapshot sink."""
