"""Language ID by compression: a text's language is that whose dictionary compresses it best."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, hash_share, likely_least, release_memory, small

#: Documents of each language, at most, of which its dictionary is made, and the dictionary's bytes.
TRAINING_DOCS = 200
DICTIONARY_BYTES = 64 << 10
#: Texts are compressed in pieces of so many bytes, all of them, so that the dictionary counts for long texts too.
PIECE_BYTES = 2048
LEVEL = 12
MIN_MATCH = 3
#: Each piece is compressed after this many bytes of the dictionary's end, and counts what it adds: alone, a few words cost as much with any dictionary.
LEAD_BYTES = 48
#: Characters of a passage, where a training text gives passages and not all of itself.
PASSAGE = 160
#: A text whose second best language needs less than this share more bytes than the best is rejected.
MIN_MARGIN = 0.004
UNDETERMINED = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")
PREDICTION = "lang_pred string, score double, margin double, rejected boolean"


def train(labelled: DataFrame, docs_per_lang: int = TRAINING_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each language of ``labelled(text, lang)``; rows with a null are left out.

    Fitted on at most ``docs_per_lang`` different texts of a language, those with the least hashes; repeated rows count
    once. Each gives an even share of the dictionary: all of itself, or of a longer text passages of ``PASSAGE``
    characters from all over it.
    """
    bounded_batches(labelled.sparkSession)
    known = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", hash_share(F.col("text")).alias("h"))
    # of distinct texts: all copies of one have the same hash
    totals = small(known.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("total")))
    rows = known.join(totals, "lang").where(likely_least(F.col("h"), docs_per_lang, F.col("total")))
    rows = rows.groupBy("lang", "h").agg(F.min("text").alias("text"), F.first("total").alias("total"))  # copies of one text count once
    w = Window.partitionBy("lang").orderBy("h")  # of about twice docs_per_lang rows
    picked = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= docs_per_lang)
    n = F.ceil(dictionary_bytes / (PASSAGE * F.least("total", F.lit(docs_per_lang)))).cast("int")
    step = (F.length("text") / n).cast("int")
    passages = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * step + 1, F.lit(PASSAGE)))
    part = F.when(F.length("text") <= n * PASSAGE, F.col("text")).otherwise(F.array_join(passages, " "))
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in picked.select("lang", "k", part.alias("t")).collect():  # a dictionary's characters of each language
        by_lang.setdefault(r["lang"], []).append((r["k"], r["t"]))
    return {lang: letters(" ".join(t for _, t in sorted(rows)))[-dictionary_bytes:] for lang, rows in sorted(by_lang.items())}


@cache
def _numbers() -> frozenset[str]:
    """Word characters that are neither letters (Unicode category L) nor decimal digits."""
    return frozenset(c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def letters(text: str) -> bytes:
    """What of a text is compressed: its words of letters in lower case."""
    text = text.lower()
    if not text.isascii() and (found := _numbers().intersection(text)):
        text = text.translate(dict.fromkeys(map(ord, found), " "))
    return _NO_LETTERS.sub(" ", text).encode("utf-8", "replace")


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, level: int = LEVEL):
        import zstandard as z

        self.langs = sorted(dictionaries)
        self.min_margin = min_margin
        self._compress, self._lead = [], []
        for lang in self.langs:
            size = max(1, len(dictionaries[lang]))
            how = z.ZstdCompressionParameters.from_level(level, source_size=LEAD_BYTES + PIECE_BYTES, dict_size=size, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self._compress.append(z.ZstdCompressor(dict_data=d, compression_params=how).compress)
            lead = dictionaries[lang][-LEAD_BYTES:]
            self._lead.append((lead, len(self._compress[-1](lead))))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """lang_pred, score, margin, rejected."""
        raw = letters(text or "")
        if not raw.strip() or not self.langs:
            return UNDETERMINED, 0.0, 0.0, True
        pieces = [raw[k : k + PIECE_BYTES] for k in range(0, len(raw), PIECE_BYTES)]
        sizes = []
        for lang, compress, (lead, alone) in zip(self.langs, self._compress, self._lead, strict=True):
            sizes.append((max(1, sum(len(compress(lead + p)) - alone for p in pieces)), lang))
        return self._told(sorted(sizes))

    def _told(self, sizes: list[tuple[int, str]]) -> tuple[str, float, float, bool]:
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 1.0, False
        margin = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], margin / (margin + self.min_margin), margin, margin < self.min_margin


def predict(dictionaries: dict[str, bytes], text: Column, min_margin: float = MIN_MARGIN) -> Column:
    """A struct (lang_pred, score, margin, rejected) for each text.

    lang_pred: the language of the least compressed size, the first by name of equals; ``und`` if the text is null,
    empty or has no letters, or no language was learned. Long texts are compressed whole, in pieces; repeated rows are
    told alike, each row by its text alone. margin: the share of bytes saved against the second best; score: 0 to
    1, 0.5 where the margin is ``min_margin``. Rejected: und, or a narrower margin.
    """

    @F.pandas_udf(PREDICTION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = Classifier(dictionaries, min_margin)
        for texts in batches:
            yield pd.DataFrame([c.predict(t) for t in texts], columns=["lang_pred", "score", "margin", "rejected"])
        release_memory()

    return run(text.cast("string"))
