"""Readers of snapshots and change logs."""
