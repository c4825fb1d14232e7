"""Shared by the tests; not named conftest, so that no other folder's can stand in."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def rows(df, cols=None):
    """Sorted list of tuples (column subset optional) for comparisons."""
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
