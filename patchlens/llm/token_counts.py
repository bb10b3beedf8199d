"""Token counts with the whole-token shortcut."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm import bpe
from patchlens.llm.common import slices, small_batches


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that are proven, by encoding each of them, to be one token alone; none for files of other kinds."""
    return [] if path.endswith(".model") else list(bpe.load(path).known())


def special_strings(path: str) -> tuple[str, ...]:
    """The strings of a tokenizer's special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return tuple(model.id_to_piece(i) for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i))
    return tuple(bpe.load(path).special)


@functools.lru_cache(1)
def counter(path: str, whole=None):
    """A function from texts to their numbers of tokens, made once in each Python worker.

    whole: a broadcast of whole_tokens(path). For a tokenizers file of the
    byte-level kind these count as 1 without more work, all other pre-tokens
    are merged. Other files go to their library.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(x) for x in model.encode(list(texts), num_threads=1)], np.int64)
    loaded = bpe.load(path)
    known = bpe.Remembering(dict.fromkeys(whole.value if whole else whole_tokens(path), 1), lambda s: len(loaded.merge(s)))
    return lambda texts: bpe.count(path, texts, known)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: id_col, n_bytes (long, UTF-8), n_tokens (long), over_limit (boolean: n_tokens > limit).

    The whole tokens are proven on the driver, once, and broadcast (at most a
    string per id of the vocabulary). The file at `path` must exist on every machine. Counts are those of the
    library for that file, without begin, end or added special tokens; strings
    of special tokens inside a text are handled as the library's default does.
    Texts are read whole, in blocks of bounded size; no shuffle. Null text
    counts as empty (0 bytes, 0 tokens); null and repeated ids stay as rows;
    an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = d.schema["id"].dataType.simpleString()

    def counted(batches):
        for b in slices(batches, 1):
            texts = b.column(1)
            n = counter(path, whole)(texts.to_pylist())
            size = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = d.mapInArrow(counted, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
