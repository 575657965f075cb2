"""Awkward documents."""

import random

WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ["", "n", "r", "ST", "é"]]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def cases():
    """Documents with every awkward property: nulls, empty, short, copies, near copies, periodic, very long."""
    a, b, c = prose(1, 120), prose(2, 90), prose(3, 20_000)
    near = a.split()
    near[60] = "changed"
    return [
        (0, a), (1, b), (2, a), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "One"), (9, "one two"),
        (10, "x y z " * 30), (11, c), (12, c + " tail"), (13, "lead " + b + " tail"), (14, prose(4, 60) + " " + a[:400]),
        (15, "…! ??? 123"), (16, "ÀÉ ñandú straße"), (None, a), (17, "<|endoftext|> hi"), (18, "it's we'll a\u00a0b\u2003c"),
    ]
