"""Every operator as a query over the given tables, with SQL that must give the same rows."""
