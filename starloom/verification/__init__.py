"""Every operator as a query over the test tables, and the same question in plain SQL."""
