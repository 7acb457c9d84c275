"""Small document tables for the corpus operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ("the of and to in that rain stone river cloud paper green quiet north window seven "
         "market bread letter under along bright morning engine silver garden winter").split()


def documents(spark, rows, extra: bool = False):
    """Rows are (id, text) or (id, text, lang, source)."""
    full = [(r[0], r[1], *(r[2:] or ("en", "src0")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:   # columns whose names an operator might use itself
        for name in ("id", "doc", "key", "host", "line", "digest", "queue", "copies", "n_tokens",
                     "n_lines", "kept", "size", "place", "range", "domain", "words"):
            df = df.selectExpr("*", f"'{name}' AS {name}")
    return df


def prose(seed: int, words: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(50)) for _ in range(words))


def odd_rows():
    """Nulls, empties, white space, repeated rows, ties, a long text."""
    long_text = "\n".join(prose(k, 40) for k in range(300))
    return [
        (1, None, None, None), (2, "", "en", "src1"), (3, " \n\t ", "fr", "src1"),
        (4, prose(1, 60), "en", "src2"), (4, prose(1, 60), "en", "src2"),
        (None, prose(2, 30), "en", None), (None, prose(1, 60), None, "src2"),
        (5, long_text, "de", "src1"), (6, "one two", "en", "src2"), (7, "one  two", "en", "src3"),
        (8, prose(1, 59) + " changed", "en", "src2"), (-9, "é ü 漢字 𝒳 " * 20, "es", "src0"),
    ]
