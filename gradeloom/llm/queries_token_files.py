"""Query op8_token_files. No SQL: it is tested against the tokenizers library."""

import public_tokenizers

from .token_files import token_file_digests


def op8_token_files(spark, sf_dir):
    return token_file_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op8_token_files": op8_token_files}
ORACLES: dict[str, str] = {}
