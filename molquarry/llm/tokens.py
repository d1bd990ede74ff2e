"""Problem 8: encoding a corpus with a public byte-level tokenizer.

tiktoken with a local rank file. Long texts are cut beforehand at boundaries that no token spans, so
that one text needs little memory at a time; ids decode to the exact bytes.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.session import spread

#: Fixed value: the published splitting pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters after which a text is cut at the next safe boundary.
CHUNK = 65_536

#: No match of PATTERN spans these: text to white space, letter to digit and back.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")

_ENCODINGS: dict[str, object] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a rank file: in ``folder``, else in the installed package of public tokenizers."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def encoding(path: str):
    """The encoding of a rank file, loaded once in each Python worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """Parts of ``text`` of about ``chunk`` characters, cut only where no token can span the cut."""
    at = 0
    while len(text) - at > chunk:
        m = _SAFE.search(text, at + chunk)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(enc, text: str | None, chunk: int = CHUNK) -> list[int]:
    """Ids of a text without special tokens; the empty list for null and empty texts."""
    if not text:
        return []
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for p in pieces(text, chunk):
        out.extend(enc.encode_ordinary(p))
    return out


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each document; one pass, no shuffle unless the scan has few splits.

    Null and empty texts get the empty list; strings of special tokens within a text are ordinary text.
    Repeated rows are each encoded, whole texts of any length, other columns aren't read.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            ids = pa.array([encode(enc, t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])

    kind = dict(docs.dtypes)[id_col]
    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, bytes): the bytes that the ids stand for; null ids give null, no ids give no bytes."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            raw = [None if x is None else enc.decode_bytes(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], [id_col, "bytes"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column; 0 for null and empty."""
    path = path or vocabulary()

    @F.pandas_udf("long")
    def n(s: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([len(encode(enc, t)) if isinstance(t, str) else 0 for t in s], dtype="int64")

    return n(text)
