"""Helpers that shape plans: where intermediate tables live and how wide shuffles are."""
