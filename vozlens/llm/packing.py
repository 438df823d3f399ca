"""Packing by cutting-stock column generation.

Every text is tokenised once, whole, and closed by id 0.  Runs of ``CAPACITY`` ids
from its start are sequences of their own; what is left over (fewer ids) is an item.
The histogram of item lengths, at most ``CAPACITY`` - 1 numbers whatever the input,
goes to the driver, where a linear program over patterns (how many items of each
length share a sequence) is solved by column generation: a knapsack dynamic program
prices new patterns with the program's duals.  Patterns are rounded down, what
remains is packed best fit decreasing, and the resulting table of patterns goes back
to the executors, where the item of rank r among those of its length finds its
sequence and offset.  Ranks come from counts by (task, length), so no length, however
common, is gathered in one task.

Defined results: a null text counts as empty and is the single id 0; repeated rows
are packed each on its own; an empty table gives no pieces; other columns are
ignored; a text of any length is cut into pieces of ``CAPACITY`` and one rest.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, worker_cache

CAPACITY = 1024
#: Pretokens that a worker remembers; the table starts anew when it is full.
REMEMBERED = 100_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids for a byte-level BPE file; special tokens in a text are ordinary text.

    The file's merges are in the order of their ids, so a rank table gives the same ids
    as the file's own library, several times faster; a file of another kind is left to
    that library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    vocab = model["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
    pre = spec.get("pre_tokenizer") or {}
    ordered = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and all(vocab.get(c, 999) < 256 for c in letters)
    if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True) and spec.get("normalizer") is None and ordered:
        import tiktoken

        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("from-file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


class Ids(dict):
    """Little-endian 32-bit ids of a text, with the ids of what stands between single spaces remembered."""

    def __init__(self, path: str) -> None:
        self.encode = encoder(path)

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), dtype="<u4").tobytes()
        if len(word) <= 40:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        # a single space always starts a pretoken; runs of spaces are split by the pattern alone
        if "  " in text or text.endswith(" "):
            return np.array(self.encode(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.encode(first), dtype="<u4").tobytes() + b"".join([self[w] for w in rest])


def cut_texts(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row a text: its ids, whole sequences (start, crc, sequence), and the rest with its rank in (part, rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache("packing")
        if kept.get("ids", (None,))[0] != tokenizer:
            kept["ids"] = tokenizer, Ids(tokenizer)
        ids = kept["ids"][1]
        part = TaskContext.get().partitionId()
        ranks = [0] * capacity
        number = (part + 1) << 40
        step = 4 * capacity
        for batch in batches:
            tokens, whole, rest, crc, rank = [], [], [], [], []
            for text in batch.column(1):
                data = ids.of(text.as_py() or "") + b"\0\0\0\0"
                n = len(data) // 4
                k = n // capacity
                whole.append([{"start": i * capacity, "crc": zlib.crc32(data[i * step : (i + 1) * step]), "sequence": number + i} for i in range(k)])
                number += k
                left = n - k * capacity
                tokens.append(n)
                rest.append(left)
                crc.append(zlib.crc32(data[k * step :]))
                rank.append(ranks[left])
                ranks[left] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(tokens, pa.int64()),
                    pa.array(whole, pa.list_(pa.struct([("start", pa.int64()), ("crc", pa.int64()), ("sequence", pa.int64())]))),
                    pa.array(rest, pa.int32()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(rest), part, np.int32)),
                    pa.array(rank, pa.int64()),
                ],
                ["doc_id", "doc_tokens", "whole", "rest", "crc", "part", "rank"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, doc_tokens long, whole array<struct<start: long, crc: long, sequence: long>>, rest int, crc long, part int, rank long")


def _knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The best value of items (any number of each) within ``capacity``, and how many of which index; lengths ascend."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if p := fit[w]:
            v = best[w - lengths[:p]] + values[:p]
            i = int(v.argmax())
            if v[i] > best[w] + 1e-12:
                best[w], took[w] = v[i], i
    out: dict[int, int] = {}
    w = capacity
    while w > 0:
        if took[w] < 0:
            w -= 1
            continue
        out[int(took[w])] = out.get(int(took[w]), 0) + 1
        w -= lengths[took[w]]
    return float(best[capacity]), out


def _exhausting(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """A first basis, its solution, and the lengths in the order they end: greedy patterns, each used until it exhausts a length.

    A pattern takes the longest lengths left that fit.  Ordered by exhaustion the basis is
    triangular; a length that ends together with another gets a pattern of its own, unused.
    """
    m = len(lengths)
    basis, x, left, open_, order = np.zeros((m, m)), np.zeros(m), need.copy(), np.ones(m, dtype=bool), []
    while open_.any():
        own = np.flatnonzero(open_)
        column, room = np.zeros(m), capacity
        while (k := int(np.searchsorted(lengths[own], room, side="right"))) > 0:
            column[own[k - 1]] += 1
            room -= int(lengths[own[k - 1]])
        used = np.flatnonzero(column)
        ratios = left[used] / column[used]
        times = ratios.min()
        left[used] -= times * column[used]
        ended = used[ratios <= times * (1 + 1e-12)]
        basis[:, ended[0]], x[ended[0]] = column, times
        for i in ended[1:]:
            basis[i, i] = capacity // lengths[i]
        left[ended], open_[ended] = 0, False
        order += ended.tolist()
    return basis, x, order


def _moved(inverse: np.ndarray, column: np.ndarray) -> np.ndarray:
    """inverse @ column for a column of few entries, without threads of a linear-algebra library."""
    used = np.flatnonzero(column)
    return (inverse[:, used] * column[used]).sum(1)


def _pivot(inverse: np.ndarray, column: np.ndarray, r: int) -> None:
    """The inverse after ``column`` has taken place r in the basis."""
    move = _moved(inverse, column)
    used = np.flatnonzero(inverse[r])
    row = inverse[r, used] / move[r]
    touched = np.flatnonzero(move)
    inverse[np.ix_(touched, used)] -= np.outer(move[touched], row)
    inverse[r, used] = row


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = 0.002, rounds: int = 300) -> list[tuple[dict[int, int], int]]:
    """(items by length, times) that pack ``histogram`` exactly; column generation to within ``gap`` of its bound, then rounding."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), dtype=np.int64)
    if not len(lengths):
        return []
    need = np.array([histogram[int(n)] for n in lengths], dtype=float)
    m = len(lengths)
    basis, x, order = _exhausting(lengths, need, capacity)
    inverse = np.eye(m)
    for r in order:
        _pivot(inverse, basis[:, r], r)
    least = (lengths * need).sum() / capacity
    for _ in range(rounds):
        if x.sum() - least <= gap * x.sum():
            break
        duals = inverse.sum(0)
        value, found = _knapsack(lengths, duals, capacity)
        if value <= 1 + 1e-9:
            break
        least = max(least, duals @ need / value)
        column = np.zeros(m)
        for i, k in found.items():
            column[i] = k
        move = _moved(inverse, column)
        ok = np.flatnonzero(move > 1e-9)
        ratios = x[ok] / move[ok]
        r = ok[int(ratios.argmin())]
        t = max(float(ratios.min()), 0.0)
        x -= t * move
        x[r] = t
        np.maximum(x, 0, out=x)
        basis[:, r] = column
        _pivot(inverse, column, r)
    out = []
    left = need.astype(np.int64)
    for r in np.argsort(-x):
        pattern = {int(i): int(basis[i, r]) for i in np.flatnonzero(basis[:, r])}
        times = min([int(x[r] + 1e-6), *(int(left[i] // k) for i, k in pattern.items())])
        if times > 0:
            for i, k in pattern.items():
                left[i] -= k * times
            out.append(({int(lengths[i]): k for i, k in pattern.items()}, times))
    bins: list[dict[int, int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(m - 1, -1, -1):  # best fit decreasing over what rounding left
        n = int(lengths[i])
        for _ in range(int(left[i])):
            room = next((w for w in range(n, capacity + 1) if by_room[w]), None)
            if room is None:
                bins.append({})
                b, room = len(bins) - 1, capacity
            else:
                b = by_room[room].pop()
            bins[b][n] = bins[b].get(n, 0) + 1
            by_room[room - n].append(b)
    return out + [(b, 1) for b in bins]


def _placing(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each (length, first rank), in order: copies in a sequence, first sequence, offset. A few rows a pattern."""
    cursor: dict[int, int] = {}
    rows = []
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows.append((n << 40 | cursor.get(n, 0), k, sequence, offset))
            cursor[n] = cursor.get(n, 0) + k * times
            offset += k * n
        sequence += times
    rows.sort()
    return {name: np.array(x, dtype=np.int64) for name, x in zip(("at", "copies", "sequence", "offset"), zip(*rows, strict=True), strict=True)} if rows else {}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = materialize(cut_texts(docs, tokenizer or default_tokenizer(), capacity), "cut")
    items = cut.where("rest > 0")
    by_part = items.groupBy("part", "rest").agg(F.count("*").alias("n"))
    plan = _placing(patterns({r.rest: r.n for r in by_part.groupBy("rest").agg(F.sum("n").alias("n")).collect()}, capacity))
    before = F.sum("n").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = by_part.select("part", "rest", F.coalesce(before, F.lit(0)).alias("first"))
    sent = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rest, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4))
            row = np.searchsorted(at["at"], rest << 40 | rank, side="right") - 1
            done = rank - (at["at"][row] & ((1 << 40) - 1))
            copies = at["copies"][row]
            tokens = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens - rest), pa.array(rest), batch.column(3), batch.column(1), pa.array(at["sequence"][row] + done // copies), pa.array(at["offset"][row] + done % copies * rest)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    ranked = items.join(first, ["part", "rest"]).select("doc_id", "doc_tokens", "rest", "crc", (F.col("rank") + F.col("first")).alias("rank"))
    rests = ranked.mapInArrow(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    whole = cut.select("doc_id", "doc_tokens", F.explode("whole").alias("w")).select(
        "doc_id", F.col("w.start").alias("start"), F.lit(capacity).cast("long").alias("length"), F.col("w.crc").alias("ids_crc32"), "doc_tokens", F.col("w.sequence").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return rests.unionByName(whole)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every document, sequences of 1024."""
    return pack(table(spark, sf_dir, "documents"))
