"""Registered queries over the driver's tables, each with the SQL of the same rows where SQL has one."""
