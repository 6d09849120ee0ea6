"""Operators that prepare training text at scale; see README, section "Training-data operators"."""
