"""Column expressions on band arrays and temperature distributions."""
