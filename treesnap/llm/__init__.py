"""Operations of a training-data pipeline over ``documents``-like tables.

Nothing else in the library imports this subpackage. Each module holds one
operator with its general interface and, where the registered query needs
one, a thin digest of its output."""
