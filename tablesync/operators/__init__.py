"""Synchronisation steps as DataFrame transformations."""
