"""Operators for preparing training text at corpus scale; nothing outside imports them."""
