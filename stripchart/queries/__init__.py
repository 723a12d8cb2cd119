"""Queries over the driver's tables, one per operator, each with the SQL it must agree with."""
