"""Helpers of the tests in this folder."""

LONG = "Word number one, and the mit license here. " * 6000


def rows_of(df):
    return [tuple(r) for r in df.collect()]
