"""Runs that take what has arrived, then stop."""
