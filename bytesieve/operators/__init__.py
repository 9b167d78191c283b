"""DataFrame transformations: counting, vocabularies, filters, order, search, flows."""
