"""How plans are cut, and the queries built from the operators."""
