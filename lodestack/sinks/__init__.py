"""Sinks: reports, releases, cards, processed volumes, logs."""
