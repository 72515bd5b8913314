"""Documents that break careless operators."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, row string, digest string, doc string"
VOCABULARY = "/opt/tokenizers"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, names that clash with added columns."""
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [
        (1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (None, base), (None, None), (7, prose(rng, 30_000)),
        (8, prose(rng, 3)), (9, " ".join(words[30:70]) + "\n" + prose(rng, 80)), (10, "a b c d e f g h " * 40), (11, prose(rng, 200).upper() + " !!"), (12, "é ü ß\u00a0x \u2003y"),
    ]
    extra = ("no", "7", "r", "d", "x")
    rows = [(i, t, ("en", None, "de")[k % 3], (None, "s1", "s1", "s2")[k % 4], None if t is None else len(t), *extra) for k, (i, t) in enumerate(texts)]
    return rows + [rows[2], (None,) * 10]
