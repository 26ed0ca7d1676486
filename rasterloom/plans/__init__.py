"""Chains of image operators, composed before they become DataFrame plans."""
