"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

The vocabulary maps byte strings to ranks.  ``build_model`` serialises it as a
sentencepiece BPE model: each byte becomes one printable character, each entry
one piece whose score is its negative rank, and the normaliser is the identity.
The best-scored merge is then the lowest rank, leftmost first, as in the rank
file's own merge rule.  A pre-token that is itself an entry keeps that entry's
id, also when no chain of merges reaches it.  Decoding maps ids back to bytes.

Nulls and empty texts have no tokens.  Texts of any length are encoded whole.
Repeated rows give equal rows.  An empty table gives an empty result.  Columns
besides the id and text columns are never read, so their names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import table

#: Entries of the pre-token cache of one worker; a full cache starts anew.
CACHE = 200_000


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    out = [""] * 256
    for b in keep:
        out[b] = chr(b)
    for i, b in enumerate(rest):
        out[b] = chr(256 + i)
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def build_model(ranks: dict[bytes, int]) -> bytes:
    """Serialised sentencepiece BPE model whose piece ids are the ranks."""
    chars = byte_characters()
    m = model_pb2.ModelProto()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0 to n - 1")
    for rank, piece in enumerate(by_rank):
        m.pieces.add(piece="".join(map(chars.__getitem__, piece)), score=-float(rank), type=model_pb2.ModelProto.SentencePiece.NORMAL)
    m.pieces.add(piece="<unk>", score=0.0, type=model_pb2.ModelProto.SentencePiece.UNKNOWN)
    t = m.trainer_spec
    t.model_type = model_pb2.TrainerSpec.BPE
    t.vocab_size = len(by_rank) + 1
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = len(by_rank), -1, -1, -1
    t.byte_fallback = False
    n = m.normalizer_spec
    n.name, n.precompiled_charsmap = "identity", b""
    n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
    return m.SerializeToString()


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pieces = [b""] * len(self.ranks)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=build_model(self.ranks))
        self.find = regex.compile(pattern).findall
        self.to_chars = dict(enumerate(byte_characters()))
        self.cache: dict[str, tuple[int, ...]] = {}

    def pre_token(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        return tuple(self.model.encode(raw.decode("latin-1").translate(self.to_chars)))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for token in self.find(text or ""):
            ids = cache.get(token)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = self.pre_token(token)
                if len(token) <= 64:
                    cache[token] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, ids: bool = True, digests: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Token ids of every text, and what they decode to.

    Returns ``id_col``, the ``keep`` columns, ``n_tokens``, with ``ids`` also ``ids array<int>`` and
    ``decoded binary``, with ``digests`` also ``ids_sha256`` and ``decoded_sha256``.
    The rank file is opened on the executors, as an installed file of each.
    """
    known = default_vocabulary()
    path, pattern = path or known[0], pattern or known[1]
    given = [id_col, *keep]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in given) + ", n_tokens long" + ", ids array<int>, decoded binary" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        names = dict(enumerate(map(str, range(len(c.pieces)))))
        for big in batches:
            for start in range(0, big.num_rows, 256):
                batch = big.slice(start, 256)
                counts, lists, raws, sums, raw_sums = [], [], [], [], []
                for text in batch.column(len(given)):
                    got = c.encode(text.as_py())
                    raw = c.decode(got)
                    counts.append(len(got))
                    if ids:
                        lists.append(np.array(got, dtype=np.int32))
                        raws.append(raw)
                    if digests:
                        sums.append(hashlib.sha256(",".join(map(names.__getitem__, got)).encode()).hexdigest())
                        raw_sums.append(hashlib.sha256(raw).hexdigest())
                out = [*batch.columns[: len(given)], pa.array(counts, pa.int64())]
                fields = [*given, "n_tokens"]
                if ids:
                    out += [pa.array(lists, pa.list_(pa.int32())), pa.array(raws, pa.binary())]
                    fields += ["ids", "decoded"]
                if digests:
                    out += [pa.array(sums, pa.string()), pa.array(raw_sums, pa.string())]
                    fields += ["ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(out, names=fields)

    return df.select(*given, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``decoded binary``: the bytes of each row's ids (a null list: no bytes)."""
    given = default_vocabulary()
    path = path or given[0]
    names = [c for c in df.columns if c != "decoded"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, given[1])
        at = names.index(ids_col)
        for batch in batches:
            raws = [c.decode(x.as_py() or []) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raws, pa.binary())], names=[*names, "decoded"])

    return df.select(*names).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of every document."""
    return encode(table(spark, sf_dir, "documents"), ids=False)
