"""Small documents with every awkward case, and plain loops that the operators are held against."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rk string, size int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    return WORDS.findall(text.translate(LOWER) if lower else text)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    out = []
    for i in range(n):
        out.append(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"Word{rng.randrange(vocabulary)}")
        out.append(rng.choice([" ", " ", " ", "  ", "\n", "\t"]))
    return "".join(out)


def odd_rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Documents with nulls in every column, empty and long texts, copies, near copies and repeated rows. The last
    three columns carry names that the operators use themselves."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n\t ", "one", "One two", "one two three four", "x" * 3000, "a " * 3000, prose(rng, 4000)]
    for _ in range(n):
        texts.append(prose(rng, rng.randrange(1, 200)))
    base = prose(rng, 120)
    for i in range(12):
        parts = base.split(" ")
        for _ in range(i % 4):
            parts[rng.randrange(len(parts))] = f"edit{rng.randrange(10)}"
        texts.append(" ".join(parts))
    texts += [base, base, base.upper(), texts[12], texts[13]]
    texts.append("mail a.b+c@x-y.example.org, 10.0.0.255 999.1.1.1 4111 1111 1111 1111 +49 (30) 123-4567 \U0001f600 q@z.de.")
    rows = []
    for i, text in enumerate(texts):
        lang = None if i % 11 == 5 else ["en", "de"][i % 2]
        source = None if i % 13 == 4 else f"s{i % 5}"
        rows.append((i * 3, text, lang, source, len(text) if text else None, "no", "mine", i))
    rows.append(rows[20])
    rows.append((None, "a row without an id", None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    return rows


def odd_documents(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(3)


def labels(spark, rows: list[tuple] | None = None):
    if rows is None:
        rows = [(r[0], 0 if (r[1] or "").count("edit") else 1, 0) for r in odd_rows() if r[0] is not None]
        rows += [(None, 1, 0), (5_000_000, 0, None), (3, None, None), (rows[4][0], 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
