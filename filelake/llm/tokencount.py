"""Token counts: batch encoding in Arrow functions that return lengths only.

A byte-level BPE pre-tokenizer never joins a character with white space that
follows it, so a text may be cut before any run of white space that follows
another character: the counts of the parts add up to that of the whole.  Long
texts are cut there into pieces of at most ``PIECE`` characters, pieces are put
together into batches of about ``BATCH`` bytes, and inside a batch the parts
between such boundaries are counted once per distinct part: those not counted
before go to the tokenizer in one ``encode_batch`` call.  A text without a safe
boundary stays whole, whatever its length.

Defined results: null and empty texts have no bytes and no tokens.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelake.llm.common import by_value, small_batches

by_value(__name__)

LIMIT = 512
PIECE = 1 << 16
BATCH = 1 << 20
MEMO = 400_000
# fixed values: the characters of Unicode's White_Space
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def pieces(text: str, size: int = PIECE):
    """The text in parts of about ``size`` characters, cut at safe boundaries."""
    if len(text) <= size:
        yield text
        return
    safe = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
    at = 0
    while len(text) - at > size:
        cut = safe.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def batches_by_bytes(texts, limit: int = BATCH):
    """Lists of (row, piece) whose pieces sum to about ``limit`` bytes."""
    out, total = [], 0
    for i, t in enumerate(texts):
        for p in pieces(t) if t else ():
            out.append((i, p))
            total += len(p)
            if total >= limit:
                yield out
                out, total = [], 0
    if out:
        yield out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer_path`` names a tokenizer file that every executor has; only
    byte-level BPE files (.json) split this way, others are refused."""
    if not tokenizer_path.endswith(".json"):
        raise ValueError("only byte-level BPE .json files are counted by parts")

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(tokenizer_path)
        parts = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            total = [0] * len(texts)
            for group in batches_by_bytes(texts):
                if len(known) > MEMO:
                    known.clear()
                split = [(i, parts.findall(p)) for i, p in group]
                new = list({s for _, ss in split for s in ss if s not in known})
                known.update(zip(new, (len(e) for e in tok.encode_batch(new, add_special_tokens=False))))
                get = known.__getitem__
                for i, ss in split:
                    total[i] += sum(map(get, ss))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(total, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return (rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
