"""Best-fit-decreasing packing of token sequences.

Tokenising is the cost, so each distinct blank-separated chunk is encoded once
per worker and a document's ids are joined from the kept bytes. A chunk with
its leading blank is exactly what the tokenizer's own pattern would cut there;
texts with longer runs of white space, or special tokens, are encoded whole.

Pieces then go to groups by a hash, each of about ``GROUP`` pieces whatever
their source, and every group is packed by best-fit decreasing: a segment tree
over remaining capacities finds the tightest open bin in log2(capacity) steps.
A group leaves at most a few bins less than full, so the loss against one
global packing is a fraction of a bin in thousands.

Defined cases: a null text is empty and yields its end id alone; repeated rows
are packed as often as they occur; ties in length go by place; very long texts
are cut into full pieces; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from framewright.llm.shared import materialize

CAPACITY = 2048
END = 0
#: Pieces in one group of packing.
GROUP = 8192
#: Chunks whose ids a worker remembers, then it starts afresh; longer ones than
#: so many characters are encoded each time.
REMEMBER, LONGEST = 200_000, 256


class ChunkEncoder:
    """Ids of texts as little-endian uint32 bytes, by remembered chunks."""

    def __init__(self, tokenizer: str, ranks: str) -> None:
        self.whole = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ordinary = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.kept: dict[str, bytes | None] = {}

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk after a blank; None where white space may join it."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        return np.array(self.ordinary(" " + chunk), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """All ids of one text, without any end."""
        if not text:
            return b""
        first, *chunks = text.split(" ")
        if any(s in text for s in self.special) or not first or first[-1].isspace():
            return self._whole(text)
        kept, out = self.kept, [np.array(self.ordinary(first), "<u4").tobytes()]
        for c in chunks:
            try:
                ids = kept[c]
            except KeyError:
                ids = self._chunk(c)
                if len(c) <= LONGEST:
                    if len(kept) >= REMEMBER:
                        kept.clear()
                    kept[c] = ids
            if ids is None:
                return self._whole(text)
            out.append(ids)
        return b"".join(out)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def encoder(tokenizer: str, ranks: str) -> ChunkEncoder:
    """One encoder for each worker."""
    return ChunkEncoder(tokenizer, ranks)


def pieces(docs: DataFrame, tokenizer: str, ranks: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document and its end id.

    Columns: doc_id, piece, start, length, ids_crc32 and, on demand, ids.
    Only a document beyond ``capacity`` is cut; its first piece is the short
    one, so that all others fill a sequence of their own.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, ranks).encode
        end = np.array([END], "<u4").tobytes()
        for part in batches:
            rows = []
            for d, t in zip(part["doc_id"], part["text"], strict=True):
                ids = encode(t) + end
                n = len(ids) // 4
                ends = range((n - 1) % capacity + 1, n + 1, capacity)
                for k, stop in enumerate(ends):
                    start = 0 if not k else stop - capacity
                    own = ids[4 * start : 4 * stop]
                    rows.append((d, k, start, stop - start, zlib.crc32(own), *([own] if with_ids else [])))
            yield pd.DataFrame(rows, columns=names)

    kind = docs.select(F.col(doc_id)).schema[0].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")] + [T.StructField("ids", T.BinaryType())] * with_ids
    names = [f.name for f in fields]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut, T.StructType(fields))


class OpenBins:
    """Open bins by remaining capacity under a segment tree of their counts."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, which: int) -> None:
        """Open a bin with so much room."""
        self.bins[remaining].append(which)
        at = remaining + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove the bin with the least room of ``need`` or more."""
        at, count, size = need + self.size, self.count, self.size
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up to the first subtree on the right that has bins
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - size
        which = self.bins[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, which


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item by best-fit decreasing."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, bins = OpenBins(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            found = (capacity, bins)
            bins += 1
        room, which = found
        bin_of[i], offset[i] = which, capacity - room
        if room > n:
            tree.add(room - n, which)
    return bin_of, offset


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (with ``length``) and each row's sequence_id and offset.

    Rows are dealt to groups by a hash of their place, so that equal rows
    don't meet in one group.
    """
    rows, _ = materialize(found.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.where(F.col("length") < capacity).count() // GROUP))
    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__row")  # the same packing however rows arrive
        bins, offset = best_fit(part["length"].to_numpy(), capacity)
        out = part.drop(columns=["__row", "__group"])
        return out.assign(sequence_id=(int(part["__group"].iloc[0]) << 32) + bins, offset=offset)[schema.names]

    packed = rows.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups))).where(F.col("length") < capacity)
    # A full piece is a sequence of its own and needs no search.
    full = rows.where(F.col("length") >= capacity).select(*found.columns, (-1 - F.col("__row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.groupBy("__group").applyInPandas(fill, schema).unionByName(full)
