"""Brute-force references for the tests (plain Python, one product at a time)."""

from decimal import Decimal


def fold(rows, opening=Decimal("0")):
    """rows: list of signed quantities in order -> list of (before, after, accepted)."""
    bal = opening
    out = []
    for x in rows:
        nb = bal + x
        if nb >= 0:
            out.append((bal, nb, True))
            bal = nb
        else:
            out.append((bal, bal, False))
    return out
