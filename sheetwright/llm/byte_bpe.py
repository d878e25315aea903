"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The ranks become a tokenizers model over the printable stand-ins of the 256 bytes. A text is split by
the public pattern, each piece is encoded on its own, and the ids are decoded by reversing the byte
table. A piece that a worker has met is not encoded again.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import kept

#: Pieces that a worker remembers, and rows that it takes at a time.
KEEP_PIECES, ROWS = 250_000, 250


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next code point from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_spec(ranks: dict[bytes, int]) -> str:
    """The tokenizers JSON whose merges follow the ranks: a pair merges when its bytes have a rank, lowest rank first."""
    chars = byte_characters()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        merges += [[shown[a], shown[b]] for a, b in sorted(parts, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True}
    split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": split, "post_processor": None, "decoder": None, "model": model | {"vocab": {shown[t]: r for t, r in ranks.items()}, "merges": merges}})


class Codec:
    """Encodes and decodes by ranks; offsets are in characters of the text."""

    def __init__(self, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        ranks = read_ranks(ranks_path)
        self.tokenizer = Tokenizer.from_str(tokenizer_spec(ranks))
        self.find = regex.compile(pattern).findall
        back = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of = {i: bytes(map(back.__getitem__, t)) for t, i in self.tokenizer.get_vocab().items()}
        self.shown = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.pieces: dict[str, tuple[str, bytes]] = {}

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern: its bytes as their stand-ins, through the library's BPE model."""
        return [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]

    def coded(self, text: str) -> tuple[list[str], list[bytes]]:
        """For each piece of the text its decimal ids, joined by spaces, and the bytes they decode to."""
        if len(self.pieces) > KEEP_PIECES:
            self.pieces.clear()
        pieces = self.find(text)
        for piece in {*pieces}.difference(self.pieces):
            ids = self.encode_piece(piece)
            self.pieces[piece] = (" ".join(map(str, ids)), self.decode(ids))
        found = [self.pieces[p] for p in pieces]
        return [f[0] for f in found], [f[1] for f in found]

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self.coded(text)[0] for i in part.split(" ")]

    def decode(self, ids: list[int]) -> bytes:
        """The exact bytes: a character split over tokens comes together again as its bytes are joined."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_text(self, ids: list[int]) -> str:
        """Text of any run of ids; bytes of a character cut off at an end become U+FFFD."""
        return self.decode(ids).decode("utf-8", errors="replace")

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Character span of each token: a token holding part of a character spans that character."""
        starts, out, at = [], [], 0
        for k, c in enumerate(text):
            starts += [k] * len(c.encode("utf-8", "surrogatepass"))
        for i in self.encode(text):
            n = len(self.bytes_of[i])
            out.append((starts[at], starts[at + n - 1] + 1))
            at += n
        return out


def _codec(path: str, pattern: str) -> Codec:
    """The worker's codec; the file is read at its path, or as the copy that Spark sent with addFile."""
    return kept(f"codec|{path}|{pattern}", lambda: Codec(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (and ids, if asked for); no shuffle.

    Null and empty texts give 0 tokens and the digests of the empty string. Null ids, repeated rows and
    extra columns don't matter; an empty table gives an empty result. Texts are taken one by
    one; a very long text is one row of its batch.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n, ids, digest, back = [], [], [], []
                for text in batch.column("text"):
                    parts, decoded = codec.coded(text.as_py())
                    line = " ".join(parts)
                    n.append(line.count(" ") + 1 if line else 0)
                    digest.append(sha(line.encode()))
                    back.append(sha(b"".join(decoded)))
                    if with_ids:
                        ids.append(np.fromstring(line, dtype=np.int32, sep=" "))
                cols = [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest), pa.array(back)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(coded, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
