"""Rows that hold what the operators must bear: nulls, empty and very long texts, ties, repeats, copies and near copies."""

import random


def prose(n, seed, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}{r.choice(['', '', '', ',', '.'])}" for _ in range(n))


LINE = "This very line stands in many documents of the set"
PASSAGE = prose(70, 1)


def documents():
    base = prose(300, 2)
    words = base.split()
    rows = [
        (1, base),
        (2, base),
        (3, " ".join([*words[:150], "changed", *words[151:]])),
        (4, f"{prose(40, 3)} {PASSAGE} {prose(30, 4)}"),
        (5, f"{prose(25, 5)}\n{PASSAGE}\n{prose(35, 6)}"),
        (6, None),
        (7, ""),
        (8, " \t\n \r\n"),
        (9, f"\n  {LINE}\t\nshort\n{LINE.upper()}"),
        (10, f"{LINE}\nunique to ten\n\n{LINE}"),
        (11, LINE.lower()),
        (11, f"{LINE}\nsecond row of eleven"),
        (12, prose(30000, 7, 5000)),
        (None, f"{LINE}\n{base}"),
        (None, base),
        (13, "one"),
        (14, "two words"),
        (14, "two words"),
        (15, "Straße naïve \u00a0 ÀÉ " * 30),
        (16, "a b c a b c a b c # $ | < a b c\nx y\nx y\n\n"),
        (17, base.upper()),
    ]
    return rows


def documents_df(spark, rows=None, clash=True):
    """With columns whose names operators use within, and nulls in them."""
    rows = documents() if rows is None else rows
    if not clash:
        return spark.createDataFrame(rows, "doc_id long, text string")
    extra = [(d, t, None, "src", None if t is None else len(t), k, "k", [b"x"], k) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, doc long, key string, drop array<binary>, node long")


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
