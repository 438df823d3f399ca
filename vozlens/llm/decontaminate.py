"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

A text is normalised by lower-casing A-Z and keeping its words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; patterns are runs of ``window`` item
words with a space on either side, so a match ends at a word's end. Each text is
scanned once, and word positions map hits to code points of the original.

The benchmark is sent to executors, so its size is checked: texts of up to
``BLOCK_BYTES`` make one automaton, and a larger benchmark is dealt into blocks
of about that size, each scanned in turn, with the hits joined word by word.

Defined results: null and wordless texts have no words and no hits; an item with
no words has no window; an item that repeats (same id) counts once; a null item_id
takes no part; repeated documents give repeated rows; an empty table on either side
gives rows without hits or no rows; other columns are left alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, worker_cache

WINDOW = 10
ADDED = ("n_words", "n_hit", "hits", "item_ids")
#: UTF-8 bytes of benchmark text in one automaton.
BLOCK_BYTES = 4_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _fold() -> bytes:
    keep = bytearray(b" " * 128) + bytearray(range(128, 256))
    for a, b in (("0", "9"), ("a", "z")):
        for c in range(ord(a), ord(b) + 1):
            keep[c] = c
    for c in range(65, 91):
        keep[c] = c + 32
    return bytes(keep)


FOLD = _fold()


def word_list(text: bytes) -> list[bytes]:
    """The words of UTF-8 bytes, lower-cased."""
    return text.translate(FOLD).split()


def windows(items: list[tuple[str, bytes]], window: int) -> dict[str, set[str]]:
    """Item ids by pattern; an item of fewer words than ``window``, but not none, is one pattern."""
    out: dict[str, set[str]] = {}
    for key, text in items:
        w = word_list(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            run = b" " + b" ".join(w[i : i + window]) + b" "
            out.setdefault(run.decode("latin-1"), set()).add(key)
    return out


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> list[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks of about ``most`` bytes, by hash of their id."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("k"), F.col("text").cast("binary").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // most) or 1
    if n == 1:
        return [[(r.k, bytes(r.t)) for r in items.collect()]]
    dealt = items.withColumn("b", F.pmod(F.xxhash64("k", "t"), F.lit(n)))
    return [[(r.k, bytes(r.t)) for r in dealt.where(F.col("b") == b).collect()] for b in range(n)]


def scan(docs: DataFrame, items: list[tuple[str, bytes]], window: int = WINDOW, text: str = "text") -> DataFrame:
    """Adds n_words, n_hit, hits (which words, as a bit set, or null) and item_ids (sorted), or joins them to those of an earlier block."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    token = uuid.uuid4().hex
    old = docs.schema.fieldNames()
    later = set(ADDED) <= set(old)
    keep = [c for c in old if not later or c not in ADDED]

    def automaton() -> tuple:
        kept = worker_cache("decontaminate")
        if kept.get("automaton", (None,))[0] != token:
            import ahocorasick

            found = windows(sent.value, window)
            machine = ahocorasick.Automaton()
            for i, pattern in enumerate(found):
                machine.add_word(pattern, (pattern.count(" ") - 1, i))
            if found:
                machine.make_automaton()
            kept["automaton"] = token, machine if found else None, list(found.values())
        return kept["automaton"][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, owners = automaton()
        for batch in batches:
            column = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").cast(pa.binary())
            n_words, n_hit, hits, items_ = [], [], [], []
            for i in range(batch.num_rows):
                w = word_list(column[i].as_py())
                n_words.append(len(w))
                bits, ids = None, set()
                if later:
                    before = batch.column(batch.schema.get_field_index("hits"))[i].as_py()
                    ids.update(batch.column(batch.schema.get_field_index("item_ids"))[i].as_py())
                    bits = np.unpackbits(np.frombuffer(before, np.uint8))[: len(w)] if before else None
                if w and machine is not None:
                    line = b" " + b" ".join(w) + b" "
                    found = list(machine.iter(line.decode("latin-1")))
                    if found:
                        stops = np.cumsum([len(x) + 1 for x in w])  # the space after each word
                        change = np.zeros(len(w) + 1, dtype=np.int64)
                        last = np.searchsorted(stops, [at for at, _ in found])
                        for end, (_, (length, k)) in zip(last.tolist(), found, strict=True):
                            change[end + 1 - length] += 1
                            change[end + 1] -= 1
                            ids |= owners[k]
                        own = (np.cumsum(change[:-1]) > 0).astype(np.uint8)
                        bits = own if bits is None else bits | own
                n_hit.append(0 if bits is None else int(bits.sum()))
                hits.append(None if bits is None or not bits.any() else np.packbits(bits).tobytes())
                items_.append(sorted(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.binary()), pa.array(items_, pa.list_(pa.string()))],
                [*keep, *ADDED],
            )

    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", T.BinaryType()), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(run, out)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (its columns, without clashes) with ``ADDED`` over the whole benchmark."""
    small_batches(docs.sparkSession)
    out = docs.drop(*ADDED)
    for items in blocks(benchmark):
        out = scan(out, items, window)
    return out


def spans(text: str | None, hits: bytes | None) -> list[tuple[int, int]]:
    """The hit words' code-point ranges in the original text, neighbours joined."""
    if not text or not hits:
        return []
    # WORD's class is closed under lower-casing of A-Z but leaves capitals out
    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    bits = np.unpackbits(np.frombuffer(hits, np.uint8))[: len(words)]
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(bits).tolist():
        a, b = words[k]
        if out and k and bits[k - 1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document against every item."""
    out = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
