"""Jobs that chain the operators, and the queries registered over the test tables."""
