"""Text columns: chunks, tokens, hashed embeddings, masks, normal forms."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: chunk size, token patterns, embedding size, mask patterns ----
MAX_CHARS = 900
SEARCH_TOKEN = r"[a-z0-9_]+"
EMBED_TOKEN = r"[a-z0-9]+"
EMBED_DIMS = 256
EMAIL = r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
# a run of at least nine digits, blanks and dashes; the look-ahead checks it, the groups catch its last two digits
PHONE = r"(?U)(?<!\d)\+?(?=\d[\d\s-]{7,}\d(?!\d))[\d\s-]*(\d)[\s-]*(\d)(?!\d)"
# ---- end of fixed values ----


BLANKS = " \t\n\x0b\f\r"  # what \s matches
MEMO = 1 << 17  # tokens a task remembers


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def chunks_of(text: Column, max_chars: int = MAX_CHARS) -> Column:
    """Paragraphs packed greedily into chunks of at most ``max_chars``; a longer paragraph stays whole."""

    def pack(text: str) -> list[str]:
        done, held, size = [], [], 0
        for p in text.split("\n\n"):
            p = p.strip(BLANKS)
            if p and held and size + len(p) + 2 > max_chars:
                done.append("\n\n".join(held))
                held, size = [], 0
            if p:
                size += len(p) + 2 * bool(held)
                held.append(p)
        return [*done, "\n\n".join(held)] if held else done

    def pack_all(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else pack(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(pack_all, "array<string>")(text)


def chunk_text(docs: DataFrame, text: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per chunk with ``chunk_no`` from 0; the text column holds the chunk."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(chunks_of(F.col(text), max_chars)).alias("chunk_no", text))


def tokens(text: Column, pattern: str = SEARCH_TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def md5_mod(token: Column, dims: int) -> Column:
    """md5 of the token, read as one 128-bit number, modulo ``dims``."""
    digest = F.md5(token)
    if dims & (dims - 1) == 0 and dims <= 1 << 24:  # a power of two only needs the last digits
        return (F.conv(F.substring(digest, 27, 6), 16, 10).cast("int") % dims).cast("int")
    rest = F.lit(0).cast("bigint")
    for i in range(8):
        rest = (rest * 65536 + F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("bigint")) % dims
    return rest.cast("int")


def embed_buckets(text: Column, dims: int = EMBED_DIMS) -> Column:
    """The embedding bucket (``md5_mod``) of every token of a text. A task hashes a token once for as long as it remembers it."""

    class Buckets(dict):
        def __missing__(self, token: str) -> int:
            if len(self) >= MEMO:
                self.clear()
            self[token] = found = int(hashlib.md5(token.encode()).hexdigest(), 16) % dims
            return found

    def all_buckets(lowered: pa.Array) -> pa.Array:
        find, bucket = re.compile(EMBED_TOKEN).findall, Buckets()
        return pa.array([None if t is None else [bucket[token] for token in find(t)] for t in lowered.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(all_buckets, "array<int>")(F.lower(text))


def hash_embed(docs: DataFrame, keys: list[str], text: str, dims: int = EMBED_DIMS) -> DataFrame:
    """Sparse bag of words: (keys, bucket, weight). Equal tokens of a text are counted before they are hashed."""
    words = docs.select(*keys, F.explode(tokens(F.col(text), EMBED_TOKEN)).alias("token"))
    counted = words.groupBy(*keys, "token").agg(F.count("*").alias("n"))
    return counted.groupBy(*keys, md5_mod(F.col("token"), dims).alias("bucket")).agg(F.sum("n").cast("double").alias("weight"))


def mask_pii(text: Column) -> Column:
    """E-mail -> first letter, stars and domain; phone number -> stars and the last two digits."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "$1***@$2"), PHONE, "***$1$2")


def normalize_label(text: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def normalize_cell(value: Column) -> Column:
    """A result cell as text: numbers in one form, months and timestamps as dates, other text trimmed."""
    text = _strip(value.cast("string"))
    number = text.try_cast("double")
    return (
        F.when(number.isNotNull() & ~F.isnan(number), number.cast("string"))
        .when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01")))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]"), F.substring(text, 1, 10))
        .otherwise(text)
    )


def question_hash(question: Column, dataset: Column) -> Column:
    """24 hex digits that are equal for questions differing only in case, blanks or a final question mark."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(_strip(question)), r"\?+$", ""), r"\s+", " ")
    return F.substring(F.sha2(F.concat(dataset, F.lit("|"), plain), 256), 1, 24)


def extract_json(text: Column) -> Column:
    """The first JSON object of a reply as VARIANT: inside a fence if there is one, else the outermost braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(F.when(fenced != "", fenced).otherwise(text), r"(?s)\{.*\}", 0)
    return F.try_parse_json(F.when(outer != "", outer))
