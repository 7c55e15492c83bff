"""Hierarchical packing of documents into sequences of several context sizes.

Documents are cut into whole windows of the longest size and a rest. Rests are routed to tiers by length (2048,
1024, 512, 256). Each tier's rests open windows of the tier's size, the gaps are filled from the tiers below, largest
fitting first, and a gap that nothing fits is closed by cutting. What is left at the end of an input partition is cut
to powers of two, so that no sequence needs padding. Windows of one size are dealt in a snake to step groups, so that
the groups of a size hold the same number of sequences and nearly the same attention cost.

Every input partition packs its own documents in one pass: no shuffle, memory of one Arrow batch, and a lost task
repeats the same sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalake.llm.common import bounded_batches
from curalake.llm.tokens import encoder, vocabulary_path

TIERS = (2048, 1024, 512, 256)
STEP = 64
END_ID = 1
DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


class Packer:
    """Packs (document, start, length) spans; a span is a list [length, serial, document index, start]."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        if list(tiers) != sorted(set(tiers), reverse=True) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be falling powers of two")
        self.tiers = tiers
        self.pool: list[list[int]] = []  # rising by length
        self.windows: list[tuple[int, list[list[int]]]] = []
        self.serial = 0

    def add(self, document: int, tokens: int) -> None:
        """Route one document: whole windows at once, the rest to the pool."""
        top = self.tiers[0]
        for start in range(0, tokens - tokens % top, top):
            self.windows.append((top, [[top, 0, document, start]]))
        if tokens % top:
            self.put(tokens % top, document, tokens - tokens % top)

    def put(self, length: int, document: int, start: int) -> None:
        self.serial += 1
        insort(self.pool, [length, self.serial, document, start])

    def pack(self, last: bool) -> None:
        """Fill windows, longest tier first, while the pool can fill them; at the end cut the rest to powers of two."""
        total = sum(span[0] for span in self.pool)
        while self.pool:
            span = self.pool.pop()
            tier = next(t for t in reversed(self.tiers) if t >= span[0])
            if total < tier:
                if not last:
                    insort(self.pool, span)
                    return
                self._rest([span, *self.pool[::-1]], total)
                self.pool = []
                return
            window, gap = [span], tier - span[0]
            while gap:
                at = bisect_right(self.pool, [gap, self.serial + 1])
                if at:
                    more = self.pool.pop(at - 1)
                else:  # nothing fits: cut the shortest span
                    long = self.pool.pop(0)
                    more = [gap, 0, long[2], long[3]]
                    self.put(long[0] - gap, long[2], long[3] + gap)
                window.append(more)
                gap -= more[0]
            total -= tier
            self.windows.append((tier, window))

    def _rest(self, spans: list[list[int]], total: int) -> None:
        """Windows whose sizes are the powers of two in ``total``, filled in order and cut where they end."""
        spans = spans[::-1]
        while total:
            gap = 1 << (total.bit_length() - 1)
            total -= gap
            self.windows.append((gap, window := []))
            while gap:
                length, _, document, start = spans.pop()
                window.append([min(length, gap), 0, document, start])
                if length > gap:
                    spans.append([length - gap, 0, document, start + gap])
                gap -= min(length, gap)

    def steps(self, size: int) -> list[tuple[int, int, list[list[int]]]]:
        """(step group, window size, spans): per size, costliest first, dealt in a snake to groups of ``size`` windows."""
        out, first = [], 0
        for tier in sorted({w[0] for w in self.windows}, reverse=True):
            own = sorted((w[1] for w in self.windows if w[0] == tier), key=lambda spans: -sum(s[0] * s[0] for s in spans))
            groups = -(-len(own) // size)
            for i, spans in enumerate(own):
                turn, place = divmod(i, groups)
                out.append((first + (place if turn % 2 == 0 else groups - 1 - place), tier, spans))
            first += groups
        self.windows = []
        return out


def pack_documents(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, step: int = STEP) -> DataFrame:
    """One row per piece: document, position in it, sequence, offset there, crc32 of the piece's ids, tier and step group.

    A document is its ids followed by id 1; a null text is empty, so such a document is that one id. A null doc_id
    stays null. Repeated rows are packed once each. Only doc_id and text are read.
    """
    bounded_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, packer = encoder(path), Packer(tiers)
        kept: dict[int, tuple[object, bytes]] = {}
        base = TaskContext.get().partitionId() << 33
        serial = sequence = group = 0

        def flush(last: bool) -> pd.DataFrame:
            nonlocal sequence, group
            packer.pack(last)
            rows, done = [], packer.steps(step)
            for own, tier, spans in done:
                offset = 0
                for length, _, document, start in spans:
                    doc_id, ids = kept[document]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, len(ids) >> 2, base + sequence, offset, tier, base + group + own))
                    offset += length
                sequence += 1
            group += max((x[0] for x in done), default=-1) + 1
            waiting = {span[2] for span in packer.pool}
            for document in [d for d in kept if d not in waiting]:
                del kept[document]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in DDL.split(", ")])
            return out.astype({"doc_id": "Int64"})

        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].tolist(), coder.ids_of(batch["text"].tolist()), strict=True):
                ids += end
                kept[serial] = (None if pd.isna(doc_id) else int(doc_id), ids)
                packer.add(serial, len(ids) >> 2)
                serial += 1
            yield flush(False)
        yield flush(True)

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, DDL)
