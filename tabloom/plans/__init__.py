"""Constraints and what is decided about them on the driver, before any job runs."""
