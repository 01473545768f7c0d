"""Graphs and reports as text. Rows are rendered by column expressions; only finished lines reach the driver."""
