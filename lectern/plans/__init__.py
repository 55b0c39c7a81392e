"""Named queries over the project's tables, with SQL that says the same."""
