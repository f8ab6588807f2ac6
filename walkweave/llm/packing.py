"""Packing documents into training sequences by the sum-of-squares rule (Csirik et al. 2006).

Each remainder of a document goes to the fill level that makes the sum, over all levels, of the squared number of windows partially filled to it
least; an array holds that number for each level. Tasks pack their own rows, so nothing is shuffled. What is partially filled in the end
of a task's rows is cut further and laid end to end, so at most one window of a task is short. Small partitions are read by one task, so that it has enough documents for the rule to place most of them.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import bounded_batches, text_of

END_ID = 1
SPECIAL = "<|endoftext|>"


class LevelPacker:
    """Places pieces of 1 to capacity - 1 units online. Windows are lists of pieces; `closed` gets those that are full."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity, np.int64)  # of each fill level, the windows at it; 0 and capacity aren't partial
        self.open: list[list[list]] = [[] for _ in range(capacity)]
        self.closed: list[list] = []

    def place(self, size: int, piece) -> None:
        n, c = self.level, self.capacity
        # Change of the sum when a window rises from level h to h + size: -2 n[h] + 1 where it was partial, 2 n[h + size] + 1 where it stays so.
        change = np.empty(c - size + 1, np.int64)
        change[: c - size] = 2 * n[size:c] + 1
        change[c - size] = 0
        change[1:] -= 2 * n[1 : c - size + 1] - 1
        usable = n[: c - size + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        best = int(change.min())
        h = int(np.flatnonzero(change == best)[-1])  # of equal ones the fullest
        window = self.open[h].pop() if h else []
        if h:
            n[h] -= 1
        window.append(piece)
        if h + size == c:
            self.closed.append(window)
        else:
            n[h + size] += 1
            self.open[h + size].append(window)

    def rest(self) -> list[tuple[int, list]]:
        """The partial windows, fullest first, as (fill, pieces)."""
        return [(h, w) for h in range(self.capacity - 1, 0, -1) for w in self.open[h]]


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None):
    """Encodes texts to ids. The BPE ranks, where given, are the same vocabulary in a faster library; texts with the special token's name go to the tokenizer itself."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    slow = lambda t: whole.encode(t, add_special_tokens=False).ids
    if not ranks:
        return slow
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    probe = "It's  a probe,\n\n 12 Ünïcödé\t字\U0001f600 end "
    if fast(probe) != slow(probe):
        return slow
    return lambda t: slow(t) if SPECIAL in t else fast(t)


PIECES = StructType()
for _name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
    PIECES.add(_name, LongType())


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = 2048, keep: list[str] | None = None, column: str = "text", with_ids: bool = False, per_task: int = 8000) -> DataFrame:
    """One row per piece: the columns of `keep` (doc_id), start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where with_ids.

    tokenizer, ranks: files of a tokenizer. A document is its ids and END_ID; null counts as empty and so is END_ID alone. What exceeds the capacity is cut
    into full windows and one remainder. Repeated rows are packed each on their own. An empty table gives no rows. per_task: partitions are put together, without a shuffle, until so many documents come to each on the average."""
    bounded_batches(docs.sparkSession)
    keep = keep or ["doc_id"]
    docs = docs.coalesce(max(1, docs.count() // per_task))
    rows = docs.select(*keep, F.spark_partition_id().cast("long").alias("__task"), text_of(column).alias("__text"))
    fields = [*rows.schema.fields[: len(keep)], *PIECES.fields]
    schema = StructType(fields)
    if with_ids:
        schema = StructType(fields).add("ids", ArrayType(IntegerType()))

    def run(batches):
        encode = encoder(tokenizer, ranks)
        packer = LevelPacker(capacity)
        out: list[tuple] = []
        state = [0, 0]  # the next sequence's number, the task's number

        def close(window, start_at=0):
            offset = start_at
            for key, start, ids, total in window:
                raw = ids.astype("<u4").tobytes()
                out.append((*key, start, len(ids), zlib.crc32(raw), total, (state[1] << 33) + state[0], offset, *([ids.astype(np.int32)] if with_ids else [])))
                offset += len(ids)
            state[0] += 1

        def batch_of():
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema.names]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        kinds: list = []
        for batch in batches:
            if not kinds:
                kinds = [batch.schema.field(i).type for i in range(len(keep))] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(keep))), strict=True))
            if batch.num_rows:
                state[1] = batch.column(len(keep))[0].as_py()
            for key, text in zip(keys, batch.column(len(keep) + 1).to_pylist(), strict=True):
                ids = np.array([*encode(text), END_ID], np.uint32)
                total = len(ids)
                full = total - total % capacity
                for a in range(0, full, capacity):
                    close([(key, a, ids[a : a + capacity], total)])
                if total > full:
                    packer.place(total - full, (key, full, ids[full:].copy(), total))
                for window in packer.closed:
                    close(window)
                packer.closed.clear()
                if len(out) > 5000:
                    yield batch_of()
            yield batch_of()
        window, fill = [], 0
        for h, pieces in packer.rest():
            if h == capacity - 1 or h >= capacity - capacity // 256:  # so little padding isn't worth a cut
                close(pieces)
                continue
            for key, start, ids, total in pieces:
                while len(ids):
                    part = ids[: capacity - fill]
                    window.append((key, start, part, total))
                    fill, start, ids = fill + len(part), start + len(part), ids[len(part) :]
                    if fill == capacity:
                        close(window)
                        window, fill = [], 0
        if window:
            close(window)
        if out:
            yield batch_of()

    return rows.mapInArrow(run, schema)
