"""Token counts of texts under a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the splitting pattern these vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text_col: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """(*keep, tokens): the length of each text in tokens; null and empty texts have 0.  Strings of special
    tokens are ordinary text."""
    rows = df.select(*keep, F.coalesce(text_col, F.lit("")).alias("_text"))

    def run(batches):
        enc = _encoding(vocabulary)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long"
    return spread(rows).mapInArrow(run, schema)
