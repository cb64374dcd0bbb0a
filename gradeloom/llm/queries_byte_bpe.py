"""Query op5_byte_bpe. No SQL: it is tested against tiktoken and an exact round trip."""

import hashlib
import zlib

import public_tokenizers

from .byte_bpe import BytePairEncoder, load_ranks
from .common import arrow_map, kept_in_worker

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(data, pattern):
    e = kept_in_worker(("bpe", zlib.crc32(data.value), pattern), lambda: BytePairEncoder(load_ranks(data.value), pattern))

    def each(rows):
        out = []
        for (doc_id, *_), ids in zip(rows, e.encode_texts([t or "" for _, t in rows]), strict=True):
            out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()))
        return out

    return each


def byte_bpe_digests(docs, path: str | None = None, pattern: str | None = None):
    """One row per row of ``docs``, whatever its id. The rank file (of fixed size) is read on the driver and broadcast. Null and empty texts have no tokens; an empty table gives no rows."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    return arrow_map(docs.select("doc_id", "text"), SCHEMA, _rows, data, pattern or public_tokenizers.PATTERN)


def op5_byte_bpe(spark, sf_dir):
    return byte_bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLES: dict[str, str] = {}
