"""Small tables for the tests of the training-data operators."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10_000))
    return " ".join(words)


def odd_documents():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    return [(1, "a b c d e", "en", "s"), (1, "a b c d e", "en", "s"), (2, "A  b\tc d\ne", None, "s"), (3, None, "en", None), (4, "", "de", "s"),
            (None, "a b c d e", "en", "s"), (None, None, None, None), (5, " \n\t ", "en", "s"), (6, long, "en", "s"), (7, long + " x", "en", "s"),
            (8, "über straße ñandú 中文", "de", "s"), (9, "one", "en", "s"), (10, "a b c", "en", "s"), (11, "<|endoftext|> x", "en", "s")]


SCHEMA = "doc_id long, text string, lang string, source string"
