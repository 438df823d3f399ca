"""LM scoring by prediction by partial matching (PPM) over a pretrained byte-context trie.

The trie holds, for every byte context of up to ``ORDER`` bytes seen in the training
texts, how often each byte follows.  A byte's probability starts at the longest seen
context; where it wasn't seen there, the escape probability (method C: the share of
distinct followers) leads to the next shorter context, from which all bytes that the
longer one could have coded are excluded; below order 0 the rest of the alphabet is
uniform.  Since the followers of a context are among those of its suffix, exclusion
needs one sum a context, so scoring is array lookups.  Byte 0xFF, which UTF-8 never
has, pads the start of a text and codes its end.

Counts are made over all training texts and summed by Spark.  The trie is sent to
executors in shards by the last two context bytes, each of about ``SHARD_KEYS`` counts;
where there is more than one, each scores its share of every text and the shares are
summed.  Word counts for the base score are split by frequency: at most ``HEAD`` of
the most frequent words are sent to executors, the rest joined by a shuffle.

Defined results: a null text counts as empty and codes its end only; a null doc_id is
in no held-out fold, so it is training; repeated rows count as often as they occur;
an empty table gives an empty table; with no training texts every byte is uniform
and N is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, materialize, release, table, worker_cache
from .kernels import utf8, word_hashes

ORDER = 5
SHARD_KEYS = 6_000_000
HEAD = 1_000_000


def gram_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each byte to code (every text's bytes, then its end): its ORDER context bytes and itself, packed; and the n + 1 offsets."""
    raw, ends = utf8(column)
    size = np.diff(ends)
    padded = np.full(len(raw) + (ORDER + 1) * len(size), 255, dtype=np.uint8)
    padded[np.arange(len(raw)) + np.repeat((ORDER + 1) * np.arange(len(size)) + ORDER, size)] = raw
    key = np.zeros(max(0, len(padded) - ORDER), dtype=np.int64)
    for j in range(ORDER + 1):
        key <<= 8
        key |= padded[j : j + len(key)]
    starts = np.concatenate([[0], np.cumsum(size + ORDER + 1)])
    coded = np.ones(len(padded), dtype=bool)  # all but each text's padding
    for j in range(ORDER):
        coded[starts[:-1] + j] = False
    return key[coded[ORDER:]] if len(padded) else key, np.concatenate([[0], np.cumsum(size + 1)])


def counted(docs: DataFrame) -> DataFrame:
    """(kind, key, n): byte grams (kind 0), words (1) and texts (2) of all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        texts = 0

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held[kind]])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([c for _, c in held[kind]])[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def out(kind: int) -> pa.RecordBatch:
            keys, n = merged(kind)
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], ["kind", "key", "n"])

        for whole in batches:
            for batch in cut(whole, "text"):
                texts += batch.num_rows
                for kind, keys in ((0, gram_keys(batch.column(0))[0]), (1, word_hashes(batch.column(0))[0].view(np.int64))):
                    if len(keys):
                        held[kind].append(np.unique(keys, return_counts=True))
                        if sum(len(k) for k, _ in held[kind]) > 3_000_000:
                            held[kind] = [merged(kind)]
                            if len(held[kind][0][0]) > 1_500_000:
                                yield out(kind)
        for kind in (0, 1):
            if held[kind]:
                yield out(kind)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "n"])

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """Counts by order, with what escapes and exclusions need.

    ``grams`` are packed (context, byte) of the full order with counts; ``pairs`` the
    same of order 1 for the whole corpus, which one shard's grams may be a part of.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> None:
        self.keys: list = [None] * (ORDER + 1)
        self.counts: list = [None] * (ORDER + 1)
        k, c = grams, counts
        for j in range(ORDER, -1, -1):
            if j == 1:
                k, c = pairs, pair_counts
            self.keys[j], self.counts[j] = self._summed(k & ((1 << 8 * (j + 1)) - 1), c)
            k, c = self.keys[j], self.counts[j]
        self.contexts, self.total, self.distinct, self.shared = [], [], [], []
        for j in range(ORDER + 1):
            context, first = np.unique(self.keys[j] >> 8, return_index=True)
            self.contexts.append(context)
            self.total.append(np.add.reduceat(self.counts[j], first) if len(first) else np.zeros(0, np.int64))
            self.distinct.append(np.diff(np.concatenate([first, [len(self.keys[j])]])))
            if j and len(first):  # the counts, one order down, of the bytes that follow here
                below = self.counts[j - 1][np.searchsorted(self.keys[j - 1], self.keys[j] & ((1 << 8 * j) - 1))]
                self.shared.append(np.add.reduceat(below, first))
            else:
                self.shared.append(np.zeros(len(first), np.int64))

    @staticmethod
    def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return keys.astype(np.int64), counts.astype(np.int64)
        if (keys[1:] > keys[:-1]).all():
            return keys, counts
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(counts, first)

    @staticmethod
    def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(where):
            return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
        at = np.minimum(np.searchsorted(where, what), len(where) - 1)
        return at, where[at] == what

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of each packed gram's last byte given the bytes before it."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        cut_total, cut_distinct = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for j in range(ORDER, -1, -1):
            k = keys[left] & ((1 << 8 * (j + 1)) - 1)
            at, seen = self._find(self.keys[j], k)
            if j == ORDER:  # most end here: only their context's totals are needed
                context, known = self._context(j, k, at, seen)
            else:
                context, known = self._find(self.contexts[j], k >> 8)
            total = np.where(known, self._take(self.total[j], context) - cut_total[left], 0)
            distinct = np.where(known, self._take(self.distinct[j], context) - cut_distinct[left], 0)
            base = np.maximum(total + distinct, 1)
            hit = np.where(seen, self._take(self.counts[j], at), np.where(distinct > 0, distinct, base))
            out[left] += np.log10(hit / base)
            rest = ~seen
            kept = rest & known
            cut_total[left[kept]] = self.shared[j][context[kept]]
            cut_distinct[left[kept]] = self.distinct[j][context[kept]]
            left = left[rest]
            if not len(left):
                return out
        alphabet = 256 - len(self.keys[0])
        out[left] -= math.log10(max(alphabet, 1))
        return out

    @staticmethod
    def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return values[at] if len(values) else np.zeros(len(at), np.int64)

    def _context(self, j: int, k: np.ndarray, at: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each gram's context: by a table from gram to context where the gram was seen, else by search."""
        if not hasattr(self, "owner"):
            self.owner = np.repeat(np.arange(len(self.contexts[j])), self.distinct[j])
        context, known = self._take(self.owner, at), seen.copy()
        miss = np.flatnonzero(~seen)
        context[miss], known[miss] = self._find(self.contexts[j], k[miss] >> 8)
        return context, known


def _arrays(df: DataFrame, pieces: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """A bounded (key, n) table as arrays, sorted by key; fetched in pieces, so that the driver holds one of them twice, not all."""
    keys, counts = [], []
    for p in range(pieces):
        t = df.where(F.pmod(F.xxhash64("key"), F.lit(pieces)) == p).select("key", "n").toArrow()
        keys.append(t.column("key").to_numpy())
        counts.append(t.column("n").to_numpy())
        del t
        release(df.sparkSession)
    key, n = np.concatenate(keys), np.concatenate(counts)
    del keys, counts
    order = np.argsort(key)
    return key[order], n[order]


def _shards(grams: DataFrame, most: int) -> tuple[list[DataFrame], np.ndarray]:
    """The grams in shards of about ``most`` rows, whole pairs of last context bytes each, and which pairs there are; 65,536 rows at most decide."""
    pair = F.shiftright("key", 8).bitwiseAND(0xFFFF).cast("int")
    sizes = sorted(((r.n, r.pair) for r in grams.groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).collect()), reverse=True)
    there = np.zeros(1 << 16, dtype=bool)
    there[[p for _, p in sizes]] = True
    if sum(n for n, _ in sizes) <= most:
        return [grams], there
    bins: list[list] = []
    for n, p in sizes:
        for b in bins:
            if b[0] + n <= most:
                b[0] += n
                b[1].append(p)
                break
        else:
            bins.append([n, [p]])
    return [grams.where(F.array_contains(F.split(F.lit(",".join(map(str, b[1]))), ",").cast("array<int>"), pair)) for b in bins], there


def score_texts(docs: DataFrame, train: DataFrame, shard_keys: int = SHARD_KEYS, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs``, learnt from ``train``."""
    spark = docs.sparkSession
    counts = materialize(counted(train), "counts")
    words = counts.where("kind = 1")
    ends = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    by_count = sorted((r.n, r.c) for r in words.groupBy("n").agg(F.count("*").alias("c")).collect())
    total = sum(n * c for n, c in by_count) + ends
    distinct = sum(c for _, c in by_count) + (1 if ends else 0)
    least, room = 1, head
    for n, c in reversed(by_count):
        room -= c
        if room < 0:
            least = n + 1
            break
    tail = least > 1
    common = spark.sparkContext.broadcast(_arrays(words.where(F.col("n") >= least)))
    grams = counts.where("kind = 0")
    pairs = _arrays(grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")))
    parts, there = _shards(grams, shard_keys)
    scale = math.log10(total + distinct + 1)
    rows = None
    for number, part in enumerate(parts):
        sent = spark.sparkContext.broadcast((*_arrays(part), *pairs))
        rows_part = _scored(docs, sent, common, ends, number, len(parts), tail, there)
        if tail or len(parts) > 1:  # a shard is on the driver and the executors only while its share is made
            rows_part = materialize(rows_part, "scored")
            sent.destroy()
        rows = rows_part if rows is None else rows.unionByName(rows_part)
    if len(parts) > 1:
        first = rows.where("shard = 0").drop("score")  # a score is its text's alone, so equal texts share the sum
        shares = rows.groupBy("name", "shard").agg(F.first("score").alias("score"))
        rows = first.join(shares.groupBy("name").agg(F.sum("score").alias("score")), "name")
    if tail:
        rare = words.where(F.col("n") < least).select(F.col("key").alias("h"), F.col("n").alias("c"))
        lone = rows.select("uid", F.explode("rare").alias("r")).select("uid", "r.h", "r.k")
        more = lone.join(rare, "h").groupBy("uid").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("logs"))
        rows = rows.join(more, "uid", "left").withColumns({"n_known": F.col("n_known") + F.coalesce("known", F.lit(0)), "logs_head": F.col("logs_head") + F.coalesce("logs", F.lit(0.0))})
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs_head") - F.col("n_tokens") * scale).alias("base_score"), "score")


def _scored(docs: DataFrame, model, common, ends: int, shard: int, shards: int, tail: bool, there: np.ndarray) -> DataFrame:
    token = uuid.uuid4().hex

    def loaded() -> tuple:
        kept = worker_cache("lm_score")
        if kept.get("trie", (None,))[0] != token:
            grams, counts, pairs, pair_counts = model.value
            kept["trie"] = token, Trie(grams, counts, pairs, pair_counts), np.unique(grams >> 8 & 0xFFFF)
        return kept["trie"][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, own = loaded()
        mine = np.zeros(1 << 16, dtype=bool)
        mine[own] = True
        hashes, counts = common.value
        logs = np.log10(counts + 1.0)
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in cut(whole, "text", 1_000_000):
                n = batch.num_rows
                keys, at = gram_keys(batch.column(1))
                keys, back = np.unique(keys, return_inverse=True)  # few distinct ones, and in order they are found fast
                if shards == 1:
                    each = trie.log10(keys)
                else:  # contexts that no shard has are scored by the first
                    pair = keys >> 8 & 0xFFFF
                    here = mine[pair] | ~there[pair] if shard == 0 else mine[pair]
                    each = np.zeros(len(keys))
                    each[here] = trie.log10(keys[here])
                score = np.add.reduceat(each[back], at[:-1]) if n else np.zeros(0)
                w, by = word_hashes(batch.column(1)) if shard == 0 else (np.zeros(0, np.uint64), np.zeros(n + 1, np.int64))
                w = w.view(np.int64)
                own_words, word = np.unique(w, return_inverse=True)
                pos = np.minimum(np.searchsorted(hashes, own_words), max(len(hashes) - 1, 0))
                known = hashes[pos] == own_words if len(hashes) else np.zeros(len(own_words), bool)
                value = np.where(known, logs[pos] if len(logs) else 0.0, 0.0)[word]
                known = known[word]
                sums = np.concatenate([[0.0], np.cumsum(value)])
                seen = np.concatenate([[0], np.cumsum(known)])
                n_words = np.diff(by)
                rare = pa.array([None] * n, pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int64())])))
                if tail and shard == 0:
                    rare = rare_words(w, by, known)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.arange(uid, uid + n, dtype=np.int64)),
                        pa.array(np.full(n, shard, np.int32)),
                        pa.array(n_words + 1),
                        pa.array(np.diff(seen[by]) + (1 if ends else 0)),
                        pa.array(np.diff(sums[by]) + math.log10(ends + 1)),
                        pa.array(score),
                        rare,
                        batch.column(2),
                    ],
                    ["doc_id", "uid", "shard", "n_tokens", "n_known", "logs_head", "score", "rare", "name"],
                )
                uid += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    name = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))) if shards > 1 else F.lit(None).cast("binary")
    rows = docs.select("doc_id", "text", name.alias("name"))
    return rows.mapInArrow(run, f"doc_id {kind}, uid long, shard int, n_tokens long, n_known long, logs_head double, score double, rare array<struct<h: long, k: long>>, name binary")


def rare_words(w: np.ndarray, by: np.ndarray, known: np.ndarray) -> pa.Array:
    """For each text, its words that aren't known, with how often."""
    keys, counts, offsets = [], [], [0]
    for a, b in zip(by[:-1].tolist(), by[1:].tolist(), strict=True):
        k, c = np.unique(w[a:b][~known[a:b]], return_counts=True)
        keys.append(k)
        counts.append(c)
        offsets.append(offsets[-1] + len(k))
    none = np.zeros(0, np.int64)
    inner = pa.StructArray.from_arrays([pa.array(np.concatenate([*keys, none])), pa.array(np.concatenate([*counts, none]))], ["h", "k"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document, learnt from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    out = score_texts(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
