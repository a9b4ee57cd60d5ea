"""Small tables with everything that may go wrong: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["th", "item", "score", "lang_pred", "held_out", "slot", "position", "gone", "n_lines", "marks", "class_id", "kept", "block", "length", "rank"]

STEMS = ["ka", "lo", "mi", "ter", "san", "due", "ri", "vo", "ne", "bal"]


def prose(n: int, rng: random.Random) -> str:
    words = ["".join(rng.choice(STEMS) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words)


def document_rows() -> list[tuple]:
    rng = random.Random(4)
    base, other = prose(60, rng), prose(60, rng)
    near = base.split()
    near[30] = "changed"
    long_text = "\n".join(prose(40, rng) for _ in range(900))
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, " ".join(near), "en", "b"),
        (4, other, "de", "b"),
        (5, None, "en", "a"),
        (6, "", "en", None),
        (7, " \n\n\t ", None, "a"),
        (None, prose(30, rng), "en", "a"),
        (8, long_text, "en", "a"),
        (9, "one two", "de", "c"),
        (10, "one two", "de", "c"),
        (11, "Äther 😀 mail me: a.b@c-d.example.org, +49 (30) 1234567 or 10.0.0.1 4111 1111 1111 1111", "de", "c"),
        (12, other + "\n" + base + "\n" + prose(20, rng), "de", None),
        (13, "1234 5678 !!! ---", "en", "c"),
        (14, "x" * 5000, "en", "c"),
        (15, None, None, None),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def documents(spark, rows=None, clash: bool = True):
    df = spark.createDataFrame(document_rows() if rows is None else rows, DOCS)
    for c in CLASHING if clash else []:
        df = df.selectExpr("*", f"'{c}' AS {c}")
    return df


def write_tables(spark, folder, empty: bool = False) -> str:
    """All tables the queries read, in ``folder``."""
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, int(i in (3, 4, 12))) for i in range(1, 14)] + [(None, 1, 1), (99, 0, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(
        [(1, "u", "<p>Hello, world"), (1, "u", "<p>Hello, world"), (2, None, None), (3, "u", ""), (None, "u", "<article><p>a &amp; b</p></article>" * 3), (4, "u", "<div>" * 3000 + "deep" + "</span>" * 50)],
        "page_id long, url string, html string",
    ).selectExpr("*", "1 AS text", "2 AS n_chars")
    one = [1.0, 2.0, 3.0]
    vectors = spark.createDataFrame(
        [(1, one, 1), (2, one, 1), (2, one, 1), (3, [2.0, 4.0, 6.1], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 2.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [], 1), (11, [1.0, 2.0], 1), (None, one, 1), (12, [float("inf"), 0.0, 0.0], 1)],
        "vec_id long, embedding array<float>, label int",
    ).selectExpr("*", "'x' AS item", "'y' AS data")
    for name, df in {"documents": docs, "labels": labels, "pages": pages, "embeddings": vectors}.items():
        (df.where("false") if empty else df).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
