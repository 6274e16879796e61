"""Encoding of whole texts with a public tokenizer, by way of a cache of space-separated segments."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Segments that a worker keeps encoded in each of two generations; when the young one is full, it becomes the old one.
CACHE_SEGMENTS = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def broadcast_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer's file (a few MB) for all executors, which may not have it at the same path."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


#: Characters below this have simple rules for case and composition.
_PLAIN = "\u0130"
#: Encodings that a worker process keeps from task to task, by the tokenizer's file.
_CACHES: dict[int, list[dict[str, bytes]]] = {}


class SegmentEncoder:
    """encode(texts): the ids of whole texts, end to end, and where each text's ids end.

    The tokenizer must treat the parts of a text between spaces and line feeds on their own and emit nothing for
    white space; ``word_bpe_49k.json`` does (its split drops white space, and neither its normalizers nor its merges
    reach over it). It must also lower-case, part letters from the marks after them, and mark the ends of words: texts
    of Latin letters are lower-cased and parted beforehand, so that a word is one segment wherever it stands. The test
    compares this with the encoding of whole texts. A batch's distinct segments are found by Arrow; each is encoded once.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self.vocabulary = max(self._tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self._ends_word = np.zeros(self.vocabulary, bool)
        self._ends_word[[k for w, k in self._tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        self._generations: list[dict[str, bytes]] = [{}, {}]

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """The encodings of words of letters, many in one text; a word's last id is one that ends a word."""
        parts = [words[at : at + 500] for at in range(0, len(words), 500)]
        few = (parts[at : at + 16] for at in range(0, len(parts), 16))  # an encoding holds far more than its ids
        encoded = ((p, e) for ps in few for p, e in zip(ps, self._tokenizer.encode_batch_fast([" ".join(p) for p in ps], add_special_tokens=False), strict=True))
        for part, e in encoded:
            ids = np.array(e.ids, self.dtype)
            ends = (np.flatnonzero(self._ends_word[ids]) + 1).tolist()
            if len(ends) != len(part) or ends[-1] != len(ids):
                raise ValueError("the tokenizer does not mark the ends of words")
            start = 0
            for end in ends:
                yield ids[start:end].tobytes()
                start = end

    def _segments(self, segments: list[str]) -> list[bytes]:
        if len(self._generations[0]) > CACHE_SEGMENTS:
            self._generations[:] = [{}, self._generations[0]]
        young, old = self._generations
        found = list(map(young.get, segments))
        unknown = [k for k, b in enumerate(found) if b is None]
        together, alone = [], []
        for k in unknown:
            s = segments[k]
            if s in old:
                young[s] = old[s]
            elif s.isalpha() and max(s) < _PLAIN:
                together.append(s)
            else:
                alone.append(s)
        young.update(zip(together, self._words(together), strict=True))
        for at in range(0, len(alone), 1024):
            part = alone[at : at + 1024]
            for s, e in zip(part, self._tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                young[s] = np.array(e.ids, self.dtype).tobytes()
        for k in unknown:
            found[k] = young[segments[k]]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        plain = pc.invert(pc.match_substring_regex(texts, r"[^\x00-\x{12f}]"))
        simple = pc.replace_substring_regex(pc.utf8_lower(texts), r"(\pL)([^\pL\pN\s'])", r"\1 \2")
        parts = pc.split_pattern(pc.if_else(plain, simple, texts), " ")
        coded = parts.flatten().dictionary_encode()
        taken = pa.array(self._segments(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1] // self.dtype.itemsize
        ids = np.frombuffer(taken.buffers()[2] or b"", self.dtype)[: ends[-1]]
        return ids, ends[parts.offsets.to_numpy()[1:]]

    def documents(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """Each text's ids with the end id."""
        ids, ends = self.encode(texts)
        closing, start = np.array([end_id], self.dtype), 0
        for end in ends.tolist():
            yield np.concatenate([ids[start:end], closing])
            start = end


@cache
def worker_encoder(tokenizer_json: str) -> SegmentEncoder:
    """The encoder that a worker process keeps from task to task."""
    return SegmentEncoder(tokenizer_json)
