"""Token counts of texts under a public byte-level BPE vocabulary.

Pre-tokens of the vocabulary's pattern never reach across a single blank that stands between other
characters, so a text splits at such blanks into chunks whose counts add up. Each worker keeps the
counts of chunks it has met (emptied when full); only new chunks run through the tokenizer.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.session import vocabulary_dir

VOCABULARY = "byte_bpe_50k.tiktoken"
_CACHE = 500_000
_LONGEST = 64  # longer chunks are counted without being kept
_CONTROL = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f]")
_ODD = re.compile(r"[^\S \n] | [^\S \n]")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def _encoding(path: str):
    import importlib.util
    import os

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    spec = importlib.util.spec_from_file_location("_vocabulary_files", os.path.join(os.path.dirname(path), "__init__.py"))
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """`count(text)` is the number of tokens of the text; None and '' have none."""

    def __init__(self, path: str):
        self._encode = _encoding(path).encode_ordinary
        self._known: dict[str, int] = {}

    def _miss(self, chunk: str) -> int:
        n = len(self._encode(chunk))
        if len(chunk) <= _LONGEST:
            if len(self._known) >= _CACHE:
                self._known.clear()
            self._known[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        # runs of blanks, and blanks at line ends or at either end, are not plain separators
        plain = not ("  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ")
        if plain and (text.isascii() and not _CONTROL.search(text) or not _ODD.search(text)):
            parts = text.split(" ")
        else:
            parts = _BETWEEN.split(text)
        known, miss, total, lead = self._known, self._miss, 0, ""
        for p in parts:
            chunk = lead + p
            n = known.get(chunk)
            total += miss(chunk) if n is None else n
            lead = " "
        return total


def with_token_counts(documents: DataFrame, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """The columns `keep` of the documents and n_tokens; a missing or empty text has 0 tokens."""
    path = vocabulary or f"{vocabulary_dir()}/{VOCABULARY}"
    frame = documents.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(path)
            n = [counter.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return frame.mapInArrow(run, schema)
