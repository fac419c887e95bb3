"""What several test modules share."""

SMALL = "/root/testdata/sf0.001"


def same_rows(a, b) -> bool:
    """Equal as multisets, columns in any order."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
