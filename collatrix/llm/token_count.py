"""Token counts by a two-tier lookup on the map side.

A text splits into pre-tokens that are encoded one by one, so its count is the
sum of their lengths. Tier one is a broadcast table of the frequent pre-tokens'
lengths; tier two is a cache in each worker, filled from the tokenizer. No
pre-token is shuffled but the frequent ones' counts.

Frequent pre-tokens are those of frequent words, which are at least ``PHI`` of all
words after white space, counted over the whole corpus; there can be 1 / PHI of
these at most, which bounds the table. (Words are split off ten times as fast as
pre-tokens.) Each task drops only what is under PHI / 2 of its own words, so no
frequent one is lost; the table decides speed alone, never a count.

Defined cases: a null text is empty and has no tokens; special strings in a text
are single tokens, as the library's default has it (such texts go to the library
whole); rows that repeat are counted each; an empty table gives an empty result;
other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatrix.llm.store import documents, small_batches

#: The pattern of byte-level BPE that splits text before merges (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which this pattern's Unicode tables and the library's can differ: texts with a pre-token that holds one go to the library whole.
UNSURE = regex.compile(r"[^\t\n\r\x20-\x7E¡-ɏͰ-ϿЀ-ӿ‐-‧‰-⁞€]")
PHI = 2.0**-16
#: Entries at which a worker's cache or a task's counter is cut back.
CACHE_MOST = 1_000_000
#: The length that stands for a pre-token with an unsure character: it turns any sum negative.
ASK = -(1 << 60)

_SPLIT = regex.compile(PATTERN)
_TOKENIZERS: dict[str, object] = {}
_LENGTHS: dict[str, dict[str, int]] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a process."""
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def special_strings(path: str) -> list[str]:
    """The strings of the added tokens."""
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


def lengths_of(tokens: list[str], path: str) -> dict[str, int]:
    """Lengths of pre-tokens, from the library; ``ASK`` for those with an unsure character."""
    encoded = tokenizer(path).encode_batch(tokens, add_special_tokens=False)
    return {t: ASK if UNSURE.search(t) else len(e.ids) for t, e in zip(tokens, encoded, strict=True)}


def frequent_lengths(texts: DataFrame, text: str, path: str, phi: float = PHI) -> dict[str, int]:
    """Lengths of the pre-tokens of the words that are at least ``phi`` of all: 1 / phi words at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        n = 0
        for batch in batches:
            for x in batch["text"]:
                if x is not None:
                    found = x.split()
                    n += len(found)
                    seen.update(found)
            if len(seen) > CACHE_MOST:
                least = max(2, n * phi / 4)
                seen = Counter({k: v for k, v in seen.items() if v >= least})
        kept = [(k, v) for k, v in seen.items() if v >= n * phi / 2]
        yield pd.DataFrame({"token": [k for k, _ in kept] + [None], "n": [v for _, v in kept] + [n]})

    counted = texts.select(F.col(text).alias("text")).mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.col("token").isNotNull(), F.desc("n")).limit(int(1 / phi) + 1).collect()
    all_n = most[0]["n"] if most else 0
    words = [r["token"] for r in most[1:] if r["n"] >= all_n * phi]
    return lengths_of(list({t for w in words for t in _SPLIT.findall(" " + w)}), path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", phi: float = PHI) -> DataFrame:
    """Per row its key, n_bytes (UTF-8) and n_tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, text, path, phi))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, cache = frequent.value, _LENGTHS.setdefault(path, {})
        special, encode = special_strings(path), tokenizer(path).encode_batch
        for batch in batches:
            if len(cache) > CACHE_MOST:
                cache.clear()
            if not cache:
                cache.update(table)
            split = [_SPLIT.findall(x) for x in batch]
            missed = {t for found in split for t in found if t not in cache}
            cache.update(lengths_of(list(missed), path))
            counts = [sum(map(cache.__getitem__, found)) for found in split]
            ask = [i for i, (x, n) in enumerate(zip(batch, counts, strict=True)) if n < 0 or any(s in x for s in special)]
            for i, e in zip(ask, encode([batch.iloc[i] for i in ask], add_special_tokens=False), strict=True):
                counts[i] = len(e.ids)
            yield pd.Series(counts, dtype="int64")

    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias(key), F.octet_length(body).cast("long").alias("n_bytes"), tokens(body).alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
