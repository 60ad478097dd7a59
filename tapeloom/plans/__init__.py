"""Named queries, each paired with SQL where SQL can state it."""
