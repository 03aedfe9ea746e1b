"""Plans: the panels that the test tables give, and the queries over them with their SQL."""
