"""Which texts contain which passages: all passages are searched for in one pass over a text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20  # of passages that every task holds at a time


def containing(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id and doc_id for every passage (query_id, passage) and document (doc_id, text) whose text contains it, once each.

    An automaton over the passages meets a text once, however many passages there are; they are shared with all tasks in blocks
    of bounded size, one after the other. Null and empty passages are in no text.
    """
    rows = passages.where("length(passage) > 0").select("query_id", "passage")
    size = rows.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = [rows.where(F.pmod(F.xxhash64("query_id", "passage"), F.lit(blocks)) == b) if blocks > 1 else rows for b in range(blocks)]
    return reduce(DataFrame.unionAll, [_one_block(documents, part) for part in parts]).distinct()


def _one_block(documents: DataFrame, passages: DataFrame) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast([(r["query_id"], r["passage"]) for r in passages.collect()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by: dict[str, list[int]] = {}
        for query, passage in shared.value:
            by.setdefault(passage, []).append(query)
        automaton = ahocorasick.Automaton()
        for passage, queries in by.items():
            automaton.add_word(passage, queries)
        automaton.make_automaton()
        for b in batches:
            found: list[tuple[int, int]] = []
            if by:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if text:
                        found.extend((q, doc) for q in {q for _, queries in automaton.iter(text) for q in queries})
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["query_id", "doc_id"])

    return documents.select("doc_id", "text").mapInArrow(search, "query_id long, doc_id long")
