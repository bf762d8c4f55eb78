"""Small tables with the awkward cases: NULLs, empty and long texts, ties, repeats, clashing columns."""

import random

SYLLABLES = ["ka", "to", "mi", "ren", "sol", "du", "pa", "vel", "or", "ish"]


def prose(seed, n_words, line=14):
    r = random.Random(seed)
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n_words)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n_words, line))


def documents(spark, extra=()):
    base = [prose(k, 60 + 7 * k) for k in range(12)]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(base)]
    near = base[3].split(" ")
    near[20] = "changed"
    rows += [
        (20, base[3], "en", "src1", 0),  # a copy
        (21, " ".join(near), "en", "src1", 0),  # a near copy
        (22, base[5] + "\n" + base[6], "en", None, 0),  # shared passages
        (23, None, None, None, None),
        (24, "", "en", "src0", 0),
        (25, " \t\n\x0b ", "en", "src2", 0),
        (26, "two words", "fr", "src2", 0),
        (27, "Two WORDS", "fr", "src2", 0),
        (28, prose(99, 30_000), "en", "src0", 0),
        (28, prose(98, 80), "en", "src0", 0),  # an id twice
        (29, base[4], "en", "src2", 0),
        (29, base[4], "en", "src2", 0),  # a row twice
        (None, prose(97, 90), "en", "src9", 0),
        (31, "### $$$ &&& " * 40, "en", "src1", 0),
        (32, "again and again and " * 60, "en", "src1", 0),
        (33, "éÉ ÀÉ x ß <|endoftext|> 3.14 don't 中文 Σ\n" * 30, "fr", "src0", 0),
        *extra,
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # columns that operators might use inside
    return frame.selectExpr("*", "doc_id AS size", "source AS key", "lang AS n", "n_chars AS vector", "text AS label")


def empty(spark):
    return documents(spark).where("false")
