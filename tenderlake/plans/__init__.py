"""Analytical views over procurement rows and bids."""
