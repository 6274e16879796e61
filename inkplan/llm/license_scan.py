"""License scans by a positional rare-token index over licence templates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, py_words, words
from .license_templates import BASE_PHRASES, TEMPLATES

#: The share of a template's words that must stand at their places.
MIN_COVERAGE = 0.75
#: A word may be shifted by so many words against its place.
SLACK = 2

FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass
class Index:
    """Postings (template, position) of all words of the templates, with each word's IDF over the corpus.

    A file's licence words are looked up from the rarest on. A template of which too few words are in the file is out.
    Of the rest, the places of the file's rarest words give offsets; where the offsets of two of them meet, the whole
    template is held against the file. A place with enough words at their positions lacks few of them: so many of the
    rarest are looked up that two of those are there, and no place is missed.
    """

    idf: dict[str, float]
    phrases: dict[str, str] = field(default_factory=lambda: BASE_PHRASES)
    templates: list[tuple[str, str, list[str]]] = field(default_factory=lambda: TEMPLATES)

    def __post_init__(self):
        self.full: list[tuple[list[str], str, list[list[str]], int]] = []  # words, label, key phrases, words that must be there
        for phrase, label in self.phrases.items():
            words = phrase.split()
            self.full.append((words, label, [words], len(words)))
        self.n_base = len(self.full)
        for label, text, keys in self.templates:
            words = py_words(text)
            self.full.append((words, label, [key.split() for key in keys if key.split()], ceil(MIN_COVERAGE * len(words))))
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for k, (words, *_) in enumerate(self.full):
            for at, w in enumerate(words):
                self.postings.setdefault(w, []).append((k, at))
        self.required = [{w for key in keys for w in key} for _, _, keys, _ in self.full]
        order = sorted(self.postings, key=lambda w: (-self.idf.get(w, 0.0), w))
        self.rank = {w: n for n, w in enumerate(order)}

    def starts(self, places: dict[str, list[int]]) -> dict[int, set[int]]:
        """Of a file's places by word: for each template the starts where two of the file's rarest words of it agree."""
        there: dict[int, list[tuple[int, str]]] = {}  # template: its positions whose words the file has, the rarest first
        for w in sorted(places, key=self.rank.__getitem__):
            for k, at in self.postings[w]:
                there.setdefault(k, []).append((at, w))
        out: dict[int, set[int]] = {}
        for k, positions in there.items():
            need = self.full[k][3]
            spare = len(positions) - need
            if spare < 0 or not need or not self.required[k] <= places.keys():
                continue
            reach = 0 if k < self.n_base else SLACK
            once: set[int] = set()
            twice: set[int] = set()
            for at, w in positions[: spare + 2]:
                offsets = {p - at + d for p in places[w] for d in range(-reach, reach + 1)}
                twice |= once & offsets
                once |= offsets
            out[k] = twice if need > 1 else once
        return out

    def scan(self, words: list[str]) -> tuple[int, int | None, int | None, str, str, float]:
        """n_base, first_word, last_word, base_labels, labels, score."""
        places: dict[str, list[int]] = {}
        for p, w in enumerate(words):
            if w in self.rank:
                places.setdefault(w, []).append(p)
        starts: list[int] = []
        base: set[str] = set()
        more: set[str] = set()
        score = 0.0
        for k, found in self.starts(places).items():
            template, label, keys, need = self.full[k]
            if k < self.n_base:
                good = [s for s in found if s >= 0 and words[s : s + len(template)] == template]
                if good:
                    starts += good
                    base.add(label)
                    score = 1.0
                continue
            for s in found:
                here, first = words[max(0, s - SLACK) : max(0, s + len(template) + SLACK)], min(s, SLACK)
                n = sum(w in here[max(0, i + first - SLACK) : max(0, i + first + SLACK + 1)] for i, w in enumerate(template))
                if n >= need and all(any(here[i : i + len(key)] == key for i in range(len(here) - len(key) + 1)) for key in keys):
                    more.add(label)
                    score = max(score, n / len(template))
        return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


def build_index(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list | None = None) -> Index:
    """The index with IDF values over all documents; the vocabulary is that of the phrases and templates."""
    phrases, templates = BASE_PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    vocabulary = sorted({w for p in phrases for w in p.split()} | {w for _, t, _ in templates for w in py_words(t)})
    own = F.array_intersect(words(F.col("text").cast("string")), F.lit(vocabulary))  # each word once
    each = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word"))  # and an empty one for each document
    counts = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each word of the vocabulary
    total = counts.pop("", 0)
    return Index({w: log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}, phrases, templates)


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of all base phrases, also overlapping ones; first_word and last_word are their least and
    largest start (null if none). score: 1 with a base phrase, else the best template's share of words found. A null
    or empty text has no words and no labels (empty strings). Of equally rare words the first by name is looked up
    first; that decides no result. Texts are scanned whole, however long; rows are independent, and repeated ones get
    the same result each. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = py_words(text)
                out.append((len(words), *index.scan(words)))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(x.split()[0] for x in FOUND.split(", "))])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {FOUND}")
