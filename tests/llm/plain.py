"""Brute-force counterparts of the operators, and the rows they are tried on."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_COLUMNS = ("n_words", "row", "value", "key", "node", "id", "part", "slot", "copy_of", "_row", "_key", "bucket", "measure")


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows, columns="doc_id bigint, text string, lang string, source string"):
    """Rows as a table that also has columns named like those operators use inside."""
    df = spark.createDataFrame(rows, columns)
    for i, c in enumerate(ODD_COLUMNS):
        if c not in df.columns:
            df = df.selectExpr("*", f"'x{i}' AS `{c}`")
    return df


def vocabulary(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    vocab = vocabulary(400)
    long = " ".join(rng.choice(vocab) for _ in range(30_000))
    some = " ".join(rng.choice(vocab) for _ in range(120))
    return [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "a"),
        (None, some, "en", None),
        (4, some, "en", "a"),
        (4, some, "en", "a"),
        (5, some + " tail", None, None),
        (5, "other text under the same id", "en", "b"),
        (6, long, "de", "b"),
        (7, long + " x", "de", "b"),
        (8, "one", "de", "b"),
        (9, "two words", "de", "b"),
        (None, None, None, None),
        (10, "Ünï\u00a0cödé \u2028 ſpace K \U0001f600 words " * 30, "fr", "c"),
    ]


def components(nodes, linked):
    """Least reachable node of every node."""
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label
