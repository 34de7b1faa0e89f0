"""Token counts: batches of text encoded in Arrow functions that return lengths only.

Texts are cut at safe boundaries (a single space between two letters or digits, which
no token of these vocabularies crosses) into segments; segments go to the tokenizer in
batches of about equal bytes. A stretch without such a boundary stays whole. Null is
an empty text; no text is truncated, however long. Rows are counted one by one, repeated
rows alike. An empty table gives an empty result. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import portions

SEGMENT_CHARS = 1024
BATCH_BYTES = 1 << 19
SAFE_SPACE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")

_loaded: dict[str, tuple[Callable[[list[str]], Iterator[int]], bool]] = {}


def encoder(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """The vocabulary's batch counter, and whether a cut keeps its space with the next segment."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)], False
        elif path.endswith(".json"):
            import json

            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            with open(path, encoding="utf-8") as file:
                byte_level = '"ByteLevel"' in json.dumps(json.load(file).get("pre_tokenizer"))
            _loaded[path] = lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)], byte_level
        else:
            raise ValueError(f"no reader for {path}")
    return _loaded[path]


def segments(text: str, keep_space: bool, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """Parts of ``text`` whose token counts add up to that of the whole."""
    start = 0
    while len(text) - start > limit and (cut := SAFE_SPACE.search(text, start + limit)):
        yield text[start : cut.start()]
        start = cut.start() if keep_space else cut.end()
    yield text[start:] if start else text


def count_texts(texts: list[str], path: str) -> list[int]:
    count, keep_space = encoder(path)
    totals, waiting, owner, size = [0] * len(texts), [], [], 0

    def flush() -> None:
        for i, n in zip(owner, count(waiting), strict=True):
            totals[i] += n

    for i, text in enumerate(texts):
        for segment in segments(text, keep_space):
            waiting.append(segment)
            owner.append(i)
            size += len(segment) if segment.isascii() else len(segment.encode())
            if size >= BATCH_BYTES:
                flush()
                waiting, owner, size = [], [], 0
    if waiting:
        flush()
    return totals


def _count(path: str):
    def run(batches):
        for batch in portions(batches):
            text = pc.fill_null(batch.column("text"), "")
            tokens = count_texts(text.to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row, by the vocabulary file at ``vocabulary``."""
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return docs.mapInArrow(_count(vocabulary), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
