"""Shared by the tests."""


def plan(df) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def values(df, *columns):
    """Rows as sorted tuples (NULL first)."""
    rows = [tuple(r) for r in df.select(*(columns or df.columns)).collect()]
    return sorted(rows, key=lambda r: [(x is not None, x) for x in r])
