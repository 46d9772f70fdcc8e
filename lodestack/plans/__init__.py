"""Registered queries: each pairs a DataFrame plan with equivalent SQL where SQL can express it."""
