"""Bounded transfers in steps: the state from which an interrupted run goes on."""
