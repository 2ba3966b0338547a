"""Column expressions.  All of them compile into whole-stage code."""
