"""Substring dedup by sliding sentence spans.

A sentence ends after a word that ends in ``.``, ``!`` or ``?``, or before a line
break.  Where there is no such end for more than ``long`` words (lists, logs, text
without punctuation), sentences end at winnowed words: those whose hash is the least of
a window of ``long`` / 2 words, so that equal passages are parted alike wherever they stand
and no piece has more than ``long`` words.

A span is a run of at least ``sentences`` consecutive sentences of one text that has at
least ``words`` words.  Every span that occurs again, in another document or in the same
one, is found, and every sentence that a non-first occurrence covers is removed.  Spans
that lie within longer ones need no hash of their own: from each sentence the shortest
span that starts there and the shortest that ends there are hashed, and a repeated span of
any length is covered exactly by those within it, since each of its sentences but the last
few starts one that ends inside, and the last few end one that starts inside.  So with the
default parameters a passage that repeats over 50 words always holds a span.

Hashes of lower-cased words are joined globally.  The shuffle carries (hash, document),
once for each document and span; the first document of a hash is a partial aggregate, and
the join back is Spark's own, whose hot keys adaptive execution splits.  The first
occurrence is that in the document of the smallest doc_id, and within a document the earliest.

Defined results: null text stays null, and has no sentences; rows that share a doc_id
are one document, so none of them loses text to another; a row with a null doc_id is a
document of its own (equal texts without id are one) and comes after all others, by a hash
of its text; an empty text or one without repeats is returned as it was; an empty table
gives an empty table; columns named like the results are replaced, all others stay as they
are; a text of any length is read whole, in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, fresh, materialize, table
from .kernels import GOLDEN, U64, hash_ranges, lower_table, mix, powers, utf8, words

#: Sentences and words that a span has at least, and the words after which a sentence is parted.
SENTENCES, WORDS, LONG = 2, 20, 16


def winnowed(w: np.ndarray, window: int) -> np.ndarray:
    """For each start of a window of word hashes, which word of it is the least (the last of equal ones)."""
    n = len(w) - window + 1
    at, least = np.zeros(max(n, 0), np.int64), w[: max(n, 0)].copy()
    for j in range(1, window):
        here = w[j : j + len(at)]
        lower = here <= least
        at[lower], least[lower] = j, here[lower]
    return at + np.arange(len(at))


def sentence_ends(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, by: np.ndarray, w: np.ndarray, long: int) -> np.ndarray:
    """Whether a sentence ends after each word of all texts."""
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    closes = np.isin(raw[stop - 1], np.frombuffer(b".!?", np.uint8))
    closes[:-1] |= breaks[start[1:]] > breaks[stop[:-1]]
    closes[by[1:][by[1:] > by[:-1]] - 1] = True
    last = np.flatnonzero(closes)
    sizes = np.diff(np.concatenate([[-1], last]))
    upto = np.repeat(last, sizes)  # of each word, the last word of its sentence
    window = max(long // 2, 1)
    least = winnowed(w, window)
    within = np.repeat(sizes > long, sizes)[: len(least)] & (np.arange(len(least)) + window - 1 <= upto[: len(least)])
    closes[least[within]] = True
    return closes


def runs(column: pa.Array, sentences: int = SENTENCES, least: int = WORDS, long: int = LONG) -> tuple[np.ndarray, ...]:
    """Of all texts: each sentence's first byte and the byte after its last word, the index of each
    text's first sentence (n + 1 values), and the spans: text, first and last sentence, hash."""
    raw, ends = utf8(column)
    start, stop, by = words(raw, ends)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none, np.zeros(len(ends), np.int64), none, none, none, none.astype(U64)
    w = hash_ranges(lower_table()[raw], start, stop)
    closes = sentence_ends(raw, start, stop, by, w, long)
    last = np.flatnonzero(closes)  # the last word of each sentence
    first = np.concatenate([[0], last[:-1] + 1])
    text_of = np.searchsorted(by, first, side="right") - 1
    own = np.searchsorted(first, by)
    up, down = powers(len(w) + 1)
    sums = np.zeros(len(w) + 1, dtype=U64)
    np.cumsum(w * up[: len(w)], out=sums[1:])
    n = len(first)
    at = np.arange(n)
    ahead = np.maximum(at + sentences - 1, np.searchsorted(last + 1, first + least))
    ok = ahead < own[text_of + 1]
    i_, j_ = [at[ok]], [ahead[ok]]
    back = np.minimum(at - sentences + 1, np.searchsorted(first, last + 1 - least, side="right") - 1)
    ok = back >= own[text_of]
    i_.append(back[ok])
    j_.append(at[ok])
    pairs = np.unique(np.concatenate(i_) * (n + 1) + np.concatenate(j_))
    i, j = pairs // (n + 1), pairs % (n + 1)
    size = (last[j] + 1 - first[i]).astype(U64)
    h = mix((sums[last[j] + 1] - sums[first[i]]) * down[first[i]] + mix(size * U64(GOLDEN)))
    return start[first], stop[last], own, text_of[i], i, j, h


def occurrences(docs: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(h, doc_id, lone), once for each span of each text of (doc_id, lone, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text"):
                *_, text_of, i, _, h = runs(batch.column(2), *shape)
                order = np.lexsort((h, text_of))
                text_of, h = text_of[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (text_of[1:] != text_of[:-1])
                of = pa.array(text_of[new])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), batch.column(0).take(of), batch.column(1).take(of)], ["h", "doc_id", "lone"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"h long, doc_id {kind}, lone long")


def _cleaned(batch: pa.RecordBatch, text: int, marks: list, shape: tuple[int, int, int]) -> tuple[list, list, list]:
    """Texts without their covered sentences, how many sentences each had, and how many went."""
    column = batch.column(text)
    first, stop, own, text_of, i, j, h = runs(column, *shape)
    raw, ends = utf8(column)
    gone = np.zeros(len(first) + 1, dtype=np.int64)
    bounds = np.searchsorted(text_of, np.arange(batch.num_rows + 1))
    for t in range(batch.num_rows):
        a, b = bounds[t], bounds[t + 1]
        if a == b:
            continue
        again = np.ones(b - a, dtype=bool)
        again[np.unique(h[a:b], return_index=True)[1]] = False  # runs come in text order
        if marks[t]:
            again |= np.isin(h[a:b], np.array(marks[t], dtype=np.int64).view(U64))
        np.add.at(gone, i[a:b][again], 1)
        np.add.at(gone, j[a:b][again] + 1, -1)
    covered = np.cumsum(gone[:-1]) > 0
    texts, removed = [], []
    for t in range(batch.num_rows):
        a, b = own[t], own[t + 1]
        c = covered[a:b]
        removed.append(int(c.sum()))
        if not c.any():
            texts.append(column[t].as_py())
            continue
        out = [raw[ends[t] : first[a]].tobytes()]
        for s in np.flatnonzero(~c):
            upto = first[a + s + 1] if a + s + 1 < b else ends[t + 1]
            out.append(raw[first[a + s] : upto].tobytes())
        kept = b"".join(out)
        texts.append((kept if not c[-1] else kept.rstrip()).decode("utf-8", "ignore"))
    return texts, np.diff(own).tolist(), removed


def dedup_substrings(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, long: int = LONG) -> DataFrame:
    """All columns of ``docs`` with text cleaned, and n_sentences and n_removed added."""
    shape = (sentences, words, long)
    docs = docs.drop("n_sentences", "n_removed")
    #: 0, or for a row without an id the hash of its text, so that no group gathers all such rows
    lone = F.when(F.col("doc_id").isNull(), F.coalesce(F.xxhash64("text"), F.lit(1))).otherwise(F.lit(0)).cast("long")
    seen = materialize(occurrences(docs.select("doc_id", lone.alias("lone"), "text"), shape), "runs")
    first = F.min("doc_id").alias("first"), F.min(F.when(F.col("doc_id").isNull(), F.col("lone"))).alias("first_lone")
    repeated = seen.groupBy("h").agg(*first, F.count("*").alias("c")).where("c > 1").drop("c")
    after = (F.col("doc_id") > F.col("first")) | F.col("doc_id").isNull() & (F.col("first").isNotNull() | (F.col("lone") > F.col("first_lone")))
    later = seen.join(repeated, "h").where(after)
    marked, at, found = (fresh(docs, c) for c in ("marked", "lone", "marks"))
    # at most one mark for each span of a text
    marks = materialize(later.groupBy(F.col("doc_id").alias(marked), F.col("lone").alias(at)).agg(F.collect_set("h").alias(found)), "marks")
    discard(seen)
    names = docs.schema.fieldNames()
    both = docs.join(marks, docs["doc_id"].eqNullSafe(marks[marked]) & (lone == marks[at]), "left")
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole, "text"):
                texts, n, gone = _cleaned(batch, text, batch.column(len(names)).to_pylist(), shape)
                columns = [batch.column(c) for c in range(len(names))]
                columns[text] = pa.array(texts, batch.schema.field(text).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_sentences", "n_removed"])

    return both.select(*names, found).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())]))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document, with what is left of its text."""
    return dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
