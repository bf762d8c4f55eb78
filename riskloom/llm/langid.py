"""Language identification by compression.

Each language has a dictionary of raw text. A text is encoded once with every dictionary, and the
language whose dictionary gives the fewest bytes is chosen; where the runner-up is nearly as small
the choice is rejected. Texts are reduced to their lower-cased words of letters before, and
encoded in blocks, so that a long text meets the dictionary in all its parts and not only at its start.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

DICTIONARY_BYTES = 16_384
LANGUAGES = 256  # the most frequent ones get a dictionary
SAMPLE_ROWS = 400  # texts of a language that its dictionary is cut from
PASSAGE = 160  # characters taken of each, from a place given by the text's hash
BLOCK = 4096
MARGIN = 0.01
LEVEL = 3
UNDETERMINED = "und"


def letters_only(text: str | None) -> bytes:
    """The words of letters, lower-cased, one space between them."""
    if not text:
        return b""
    return " ".join(_letters().findall(text)).lower().encode("utf-8", "replace")


def _state() -> types.ModuleType:
    """Kept in the process, so that it outlives a task."""
    return sys.modules.setdefault("riskloom_langid_state", types.ModuleType("riskloom_langid_state"))


def _letters():
    kept = _state()
    if not hasattr(kept, "letters"):
        import regex

        kept.letters = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    return kept.letters


def learn_dictionaries(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary) from texts with their language, the most frequent language first.

    The fit reads a bounded sample: at most LANGUAGES languages, and of each the SAMPLE_ROWS texts
    with the smallest hashes, PASSAGE characters of each. Copies of a text count once. Rows without
    language or without a letter teach nothing.
    """
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where(
        r"lang IS NOT NULL AND text RLIKE '\\p{L}'"
    )
    ordered = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    if not ordered:
        return []
    key = F.xxhash64("text")
    room = F.greatest(F.length("text") - PASSAGE, F.lit(0)) + 1
    passage = F.substring(F.col("text"), F.pmod(key, room).cast("int") + 1, F.lit(PASSAGE))
    # cut first, so that whole texts do not travel; the smallest hashes are kept before the shuffle
    place = F.dense_rank().over(W.partitionBy("lang").orderBy("key"))
    sample = (
        rows.where(F.col("lang").isin(ordered))
        .select("lang", key.alias("key"), passage.alias("passage"))
        .withColumn("place", place)
        .where(F.col("place") <= SAMPLE_ROWS)
        .groupBy("lang", "key")
        .agg(F.min("passage").alias("passage"))
        .collect()
    )
    found: dict[str, list[tuple[int, str]]] = {name: [] for name in ordered}
    for row in sample:
        found[row["lang"]].append((row["key"], row["passage"]))
    # a match near the end of the dictionary is the cheapest, so what is cut off is its start
    return [
        (name, b" ".join([letters_only(p) for _, p in sorted(found[name])])[-DICTIONARY_BYTES:]) for name in ordered
    ]


class _Coders:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        import zstandard as z

        self.names = [name for name, _ in dictionaries]
        self.coders = []
        for _, raw in dictionaries:
            settings = z.ZstdCompressionParameters.from_level(
                LEVEL,
                source_size=BLOCK,
                dict_size=len(raw),
                min_match=3,
                strategy=z.STRATEGY_LAZY2,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            content = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            self.coders.append(z.ZstdCompressor(dict_data=content, compression_params=settings).compress)

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum([len(compress(b)) for b in blocks]) for compress in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, int | None]:
        """Language, relative margin to the runner-up, and the smallest size."""
        data = letters_only(text)
        if not data or not self.names:
            return UNDETERMINED, 0.0, None
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for k, s in enumerate(sizes) if k != best]
        margin = 1 - sizes[best] / min(others) if others else 1.0
        return self.names[best], margin, sizes[best]


def _coders(dictionaries: list[tuple[str, bytes]]) -> _Coders:
    kept = _state()
    if getattr(kept, "dictionaries", None) != dictionaries:
        kept.dictionaries, kept.coders = dictionaries, _Coders(dictionaries)
    return kept.coders


def identify(
    docs: DataFrame,
    dictionaries: list[tuple[str, bytes]],
    text: str = "text",
    margin: float = MARGIN,
) -> DataFrame:
    """Add best_lang, lang_margin (0 to 1), coded_bytes and detected_lang to every row of `docs`.

    best_lang has the smallest encoding; of equal ones the language that was more frequent in
    training. detected_lang is best_lang, or NULL where the margin is below `margin` (rejected).
    A text that is NULL or has no letter, or a fit without any language, gives 'und', margin 0 and
    no size. Columns that already have one of the four names are replaced; others are kept.
    """
    names = ["best_lang", "lang_margin", "coded_bytes"]
    docs = docs.drop(*{*names, "detected_lang"} - {text})
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    position = docs.columns.index(text)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(shared.value)
        for batch in batches:
            found = [coders.classify(t) for t in batch.column(position).to_pylist()]
            added = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    added = [StructField(name, kind()) for name, kind in zip(names, (StringType, DoubleType, LongType))]
    out = docs.mapInArrow(classify, StructType([*docs.schema.fields, *added]))
    sure = F.col("lang_margin") >= margin
    return out.withColumn("detected_lang", F.when(sure & (F.col("best_lang") != UNDETERMINED), F.col("best_lang")))
