"""Token counts of whole texts by a compiled finite-state transducer (see transducer.py).

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside a text count one token each and
split it, as the tokenizer library does by default; a null doc_id stays null; repeated rows give repeated rows; other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceweave.llm.common import in_arrow
from traceweave.llm.transducer import CountTransducer, pieces_of, read_ranks
from traceweave.llm.words import slices, text_bytes

SPECIAL = ("<|endoftext|>",)
#: One compiled transducer per vocabulary and Python worker.
_COMPILED: dict[str, CountTransducer] = {}


def compiled(path: str) -> CountTransducer:
    if path not in _COMPILED:
        _COMPILED[path] = CountTransducer(read_ranks(path))
    return _COMPILED[path]


def split_special(column: pa.Array, special: tuple[str, ...]) -> tuple[pa.Array, np.ndarray]:
    """The parts of every text between special strings, and how many parts each text has (at least one)."""
    parts = np.ones(len(column), np.int64)
    if not special:
        return column, parts
    pattern = "|".join(special).replace("|", "\\|") if len(special) == 1 else None
    held = pc.match_substring(column, special[0]) if pattern else pc.match_substring_regex(column, _any_of(special))
    held = held.fill_null(False)
    if not pc.any(held).as_py():
        return column, parts
    import re

    out: list[str | None] = []
    for i, (text, has) in enumerate(zip(column.to_pylist(), held.to_pylist(), strict=True)):
        own = re.split(_any_of(special), text) if has else [text]
        parts[i] = len(own)
        out += own
    return pa.array(out, pa.large_string()), parts


def _any_of(special: tuple[str, ...]) -> str:
    import re

    return "|".join(re.escape(s) for s in special)


def _counted(path: str, special: tuple[str, ...], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(path)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            n_bytes = np.diff(text_bytes(texts)[1])
            cut, parts = split_special(texts, special)
            pieces = pieces_of(cut)
            each = transducer.counts(pieces.distinct)[pieces.code] if len(pieces.code) else np.zeros(0, np.int64)
            total = np.concatenate(([0], np.cumsum(each)))[pieces.first]
            last = np.cumsum(parts)
            tokens = total[last] - total[last - parts] + parts - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, ranks_path: str, special: tuple[str, ...] = SPECIAL, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(
        texts, _counted(ranks_path, special, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
