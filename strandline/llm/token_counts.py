"""Token counts of texts of any length by overlap resynchronisation.

A huge text is cut into chunks that overlap. Each chunk is encoded by itself with byte offsets, and two neighbours are spliced
at a boundary that both encodings have in their overlap and that is proven stable: one between a character that isn't white
space and one that is, or one between characters of two kinds (letters, digits, other signs; apostrophes and the signs of added
special strings left out). No piece of the pre-tokenizer's pattern goes on past such a place, white space at a piece's head is
decided by what follows it alone, and an added special string has no such place inside; so the text before the place and the
text after it are encoded independently of one another, whatever stands further left or right. If the overlap has no such
boundary, it is doubled until one appears or the text ends.

Memory is that of one chunk's encoding, however long the text is, but for a run of characters of one kind (such as a script
without blanks and signs): the pattern makes it one piece, which no tokenizer can cut, so it is encoded as a whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, with_columns

#: Characters in a chunk before its overlap, and the first overlap.
CHUNK, OVERLAP = 32_768, 256
#: Only in these ranges do all Unicode versions agree on letters, numbers and white space; other texts go to the reference library.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞€]*")
# Letters, digits and signs whose kind is the same in all Unicode versions; no apostrophe, and no sign of a special string.
_LETTER, _DIGIT, _SIGN = "A-Za-zÀ-ÖØ-öø-ɏぁ-ゖァ-ヺ一-鿕가-힣", "0-9", r"!-&(-;=?@\[-`{}~、。，．！？：；（）「」…"
_SIGN = _SIGN.replace("(-;", "(-/:;")  # digits lie between them
_STABLE = re.compile(rf"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])|(?<=[{_LETTER}])(?=[{_DIGIT}{_SIGN}])|(?<=[{_DIGIT}])(?=[{_LETTER}{_SIGN}])|(?<=[{_SIGN}])(?=[{_LETTER}{_DIGIT}])")

Encoder = Callable[[str], np.ndarray]


def byte_lengths_encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    """A function from a text to the byte lengths of its tokens, as the tokenizers library encodes with json_path.

    Plain texts go through the same vocabulary as ranks, which is several times faster; texts with characters on which the
    libraries' Unicode tables may differ, or with an added special string, go through the library itself.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(json_path)
    special = {t.content for t in slow.get_added_tokens_decoder().values()}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for b, r in ranks.items():
        size[r] = len(b)

    def encode(text: str) -> np.ndarray:
        if _PLAIN.fullmatch(text) and not any(s in text for s in special):
            return size[np.array(fast.encode_ordinary(text), np.int64)]
        spans = slow.encode(text, add_special_tokens=False).offsets
        # Offsets are in characters and repeat where tokens share a character: that character's bytes count for the first of them.
        ends = np.maximum.accumulate(np.array([b for _, b in spans], np.int64)) if spans else np.empty(0, np.int64)
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate(([0], np.cumsum(1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)))).astype(np.int64)
        return np.diff(at[ends], prepend=0)

    return encode


def count_tokens(text: str, encode: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text."""
    if len(text) <= chunk + overlap:
        return len(encode(text))
    total, start = 0, 0
    while True:
        end = start + chunk
        if end + overlap >= len(text):
            return total + len(encode(text[start:]))
        wide, found = overlap, None
        while found is None:
            left_text = text[start : end + wide]
            left = np.cumsum(encode(left_text))
            if end + wide >= len(text):
                return total + len(left)
            right = np.cumsum(encode(text[end : end + wide]))
            head = len(text[start:end].encode("utf-8", "surrogatepass"))
            for m in _STABLE.finditer(text, end + 1, end + wide - 1):
                b = len(text[end : m.start()].encode("utf-8", "surrogatepass"))
                i, j = np.searchsorted(left, head + b, "right"), np.searchsorted(right, b, "right")  # tokens that share the last character end there too
                if i and left[i - 1] == head + b and j and right[j - 1] == b:
                    found = (int(i), m.start())
                    break
            wide *= 2
        total += found[0]
        start = found[1]


def token_counts(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, limit: int = 512, text_col: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Columns of docs that bear one of these names are replaced; repeated rows
    stay; an empty table gives an empty result.
    """

    def make():
        encode = byte_lengths_encoder(json_path, ranks_path, pattern)

        def run(texts: pa.Array) -> list:
            return [pa.array([count_tokens(t, encode) if t else 0 for t in texts.to_pylist()], pa.int64())]

        return run

    n_bytes: Column = F.coalesce(F.octet_length(quoted(text_col).cast("string")), F.lit(0)).cast("long")
    base = docs.drop("n_bytes", "over_limit") if text_col not in ("n_bytes", "over_limit") else docs
    out = with_columns(base.withColumn("n_bytes", n_bytes), text_col, [T.StructField("n_tokens", T.LongType())], make)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
