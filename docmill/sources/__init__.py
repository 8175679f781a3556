"""Readers of landed files, and the row functions behind them."""
