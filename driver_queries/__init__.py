"""Registered queries over the given tables, each with SQL for the same result where SQL can say it."""
