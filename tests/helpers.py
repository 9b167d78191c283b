"""Helpers that test modules import; fixtures are in conftest.py."""


def gram_dict(df, value="cnt"):
    return {bytes(row["gram"]): row[value] for row in df.collect()}
