"""Part of inkseam."""
