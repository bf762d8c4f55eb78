"""Statistics of a text in built-in expressions, one row in and one row out, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_characters, words

SYMBOLS = "#*$%&|<>"

STATISTICS = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_exclaim",
    "n_distinct_words",
]


def _ordered_windows(w: Column, size: Column, low: Column) -> Column:
    """The 3-word windows of an array as sorted 64-bit numbers: hash in the high bits, position in the low."""

    def packed(i: Column) -> Column:
        h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))

    starts = F.sequence(F.lit(0), F.greatest(size - 3, F.lit(0)).cast("int"))
    return F.when(size >= 3, F.sort_array(F.transform(starts, packed))).otherwise(F.lit([]).cast("array<bigint>"))


def _repeated_words(w: Column, keys: Column, low: Column) -> Column:
    """How many words lie in windows that occur at least twice.

    Sorting has brought equal windows side by side in n log n steps at any length; neighbours with
    equal high bits are compared word by word.
    """
    high = F.bitwise_not(low)

    def same(a: Column, b: Column) -> Column:
        p, q = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        equal = a.bitwiseAND(high) == b.bitwiseAND(high)
        for k in range(3):
            equal = equal & (F.get(w, p + k) == F.get(w, q + k))
        return F.coalesce(equal, F.lit(False))

    repeated = F.filter(keys, lambda key, i: same(key, F.get(keys, i - 1)) | same(key, F.get(keys, i + 1)))
    positions = F.sort_array(F.transform(repeated, lambda key: key.bitwiseAND(low)))
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        positions,
        start,
        lambda acc, p: F.struct(
            p.alias("last"),
            (acc["total"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def with_statistics(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the columns of STATISTICS for the text column; NULL text counts as empty.

    Columns that already have one of the names are replaced; give a prefix to keep them. Each step is the
    one row of a generator, so that a filter on the result runs after the statistics and not inside them.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [c for c in df.columns if c not in {prefix + s for s in STATISTICS}]
    given = [F.col(f"`{c}`") for c in kept]

    def step(frame: DataFrame, columns: list[Column], name: str, value: Column) -> DataFrame:
        return frame.select(*columns, F.explode(F.array(value)).alias(name))

    taken = {c.lower() for c in df.columns}
    cut, keys, found = (next(n for k in range(len(taken) + 1) if (n := f"__{x}{k}") not in taken) for x in ("cut", "keys", "found"))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = step(df, given, cut, F.struct(words(t).alias("words"), lines.alias("lines")))
    w, lines = F.col(cut)["words"], F.col(cut)["lines"]
    size = F.size(w)
    # all ones below the highest bit of the word count
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(size.cast("long")))) - 1
    out = step(
        out, [*given, F.col(cut)], keys, F.struct(_ordered_windows(w, size, low).alias("windows"), low.alias("low"))
    )
    solid = t
    for c in " \t\n\x0b\x0c\r":
        solid = F.replace(solid, F.lit(c), F.lit(""))
    statistics = {
        "n_words": size.cast("long"),
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": count_characters(t, SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeated_words(w, F.col(keys)["windows"], F.col(keys)["low"]),
        "n_lines": F.size(lines).cast("long"),
        "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"),
        "n_exclaim": count_characters(t, "!"),
        "n_distinct_words": F.size(F.array_distinct(w)).cast("long"),
    }
    out = step(out, given, found, F.struct(*[F.coalesce(statistics[s], F.lit(0)).alias(s) for s in STATISTICS]))
    return out.select(*given, *[F.col(found)[s].alias(prefix + s) for s in STATISTICS])


def ratios(prefix: str = "") -> dict[str, Column]:
    """Length-free features of a text, from its statistics; 0 where a text has no word."""

    def per(part: str, whole: str) -> Column:
        whole_column = F.col(f"{prefix}{whole}")
        value = F.col(f"{prefix}{part}") / F.nullif(whole_column, F.lit(0))
        return F.coalesce(value.cast("double"), F.lit(0.0))

    return {
        "n_words": F.col(f"{prefix}n_words").cast("double"),
        "chars_per_word": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "upper_share": per("n_upper", "word_chars"),
        "exclaim_per_word": per("n_exclaim", "n_words"),
        "distinct_share": per("n_distinct_words", "n_words"),
    }
