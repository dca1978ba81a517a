"""Reading results in tests."""


def rows(df, *order):
    """Rows as tuples, sorted by the given columns (all by default)."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]
