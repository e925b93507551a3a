"""Whole plans: the decider's contract, scheduling, and the simulation with feedback."""
