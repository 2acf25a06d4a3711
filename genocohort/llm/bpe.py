"""Byte-level BPE encoding and decoding with tiktoken and a local rank file (operator 1)."""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts beyond this many characters are encoded in pieces that end at safe boundaries; white space on end
#: of this many characters is one match, told without the pattern, whose search would need a stack as deep as the run.
PIECE_CHARS, RUN_CHARS = 65_536, 4_096

# The characters that the split pattern takes for white space.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A place where the split pattern always ends a match: a white-space character after a
#: character that is none, as white space only ever begins a match of the pattern.
_SAFE = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
_RUN = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{{RUN_CHARS},}}")


def matches_and_rest(text: str):
    """Cut ``text`` into (part, whether it is one match of the split pattern).

    White space on end is one match but for its last character, if another one follows: that begins a match of its own.
    """
    begin = 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        if begin < run.start():
            yield text[begin : run.start()], False
        yield text[run.start() : end], True
        begin = end
    if begin < len(text) or not text:
        yield text[begin:], False


def pieces(text: str, size: int = PIECE_CHARS):
    """Cut ``text`` at safe boundaries into pieces of about ``size`` characters; a stretch
    without a boundary stays whole."""
    begin, end = 0, len(text)
    while end - begin > size:
        cut = _SAFE.search(text, begin + size)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


class Codec:
    """A rank file's encoding; ``encode`` gives uint32 ids, ``decode`` raw bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._enc = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {b: a for a, b in ranks.items()}

    def encode(self, text: str) -> np.ndarray:
        found = []
        for part, whole in matches_and_rest(text):
            if whole:
                found.append(np.array(self._enc._encode_single_piece(part), np.uint32))
            else:
                found += [self._enc.encode_to_numpy(p, allowed_special=set(), disallowed_special=()) for p in pieces(part)]
        return (found[0] if len(found) == 1 else np.concatenate(found)).astype("<u4", copy=False)

    def decode(self, ids) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text of ``docs(doc_id, text)``.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` (array of
    int) if ``keep_ids``.  Null text counts as empty: no tokens, the digests of no bytes.
    A null doc_id stays null and repeated rows give repeated results; other columns are
    not read; an empty table gives no rows.  Each task reads the rank file from
    ``ranks_path``, which every executor must be able to open.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields, kind = [*fields, pa.field("ids", pa.list_(pa.int32()))], kind + ", ids array<int>"
    schema = pa.schema(fields)

    def run(batches):
        codec = Codec(ranks_path, pattern)
        for batch in batches:
            n, sha, back, kept = [], [], [], []
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                n.append(len(ids))
                sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids.tolist())).hexdigest())
                if keep_ids:
                    kept.append(ids.astype("i4"))
            made = [batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip([n, sha, back, kept], fields[1:]))]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)
