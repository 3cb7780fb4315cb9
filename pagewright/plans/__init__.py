"""Ready queries over the test tables, each with SQL that gives the same rows where SQL can."""
