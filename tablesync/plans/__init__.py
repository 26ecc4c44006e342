"""Whole runs: pull, full refresh, removal."""
