"""Named queries over the test tables, each beside the SQL that must give the same rows."""
