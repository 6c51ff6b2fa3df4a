"""Plain helpers of the tests."""


def rows(df, *order):
    """Rows as tuples, sorted by the given or all columns."""
    names = list(order) or df.columns
    return [tuple(r) for r in df.orderBy(*names).collect()]
