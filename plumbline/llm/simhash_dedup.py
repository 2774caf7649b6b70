"""Near-duplicate documents by SimHash and anchor-point covering (operator 2).

Fingerprints have 64 bits over word shingles. Two link when at most
``THRESHOLD`` = 4 bits differ; then, of their two 32-bit halves, one differs in
at most 2 bits, so the job is to find all pairs of half words within 2 bits.

Anchors of a half are the words of a covering code: a Hamming code on 31 bits
times every value of the last bit, 2**27 anchors with covering radius 1. Two
half words within 2 bits have a word midway, within 1 bit of either; that
word is within 1 bit of an anchor; so both are within 2 bits of that anchor -
covering radius plus their share of the threshold. Each distinct fingerprint
is replicated to every anchor within 2 bits of either half: 2 or 17 anchors a
half, listed by the syndrome, whatever the data. Rows that meet at an anchor
are compared, and nothing else is. No pair is missed, and by chance two
fingerprints meet at an anchor with probability below 1e-5.

Per anchor the comparison emits a star for each connected group of its rows
instead of all linked pairs, so the output stays linear in the rows however
many near copies share an anchor. Anchors with more than ``CELL`` rows are cut
into slices, and each pair of slices is a cell of its own that any executor can
take: nothing is capped, and no task holds more than two slices.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import connected_components, free_names, materialise, release, row_key

THRESHOLD = 4
#: Most rows of an anchor that one cell compares.
CELL = 4096
#: Bits of shingle hashes unpacked at a time.
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Majority bits over the XXH64 of all shingles, as an unsigned integer."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), seed)
    joined = b" ".join(parts)
    ends = list(itertools.accumulate(map(len, parts)))
    starts = [0, *[e + i + 1 for i, e in enumerate(ends[:-words])]]
    stops = [e + i for i, e in enumerate(ends)][words - 1 :]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (a signed long with the fingerprint's bits) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _corrections() -> list[list[int]]:
    """By syndrome: the masks that lead from a 32-bit word to each anchor
    within 2 bits. Column i of the Hamming code is the number i, 1 to 31, and
    stands for bit i - 1; bit 31 is free."""
    out, free = [], 1 << 31
    for s in range(32):
        if s == 0:
            out.append([0, free])
            continue
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s]
        out.append([1 << (s - 1), (1 << (s - 1)) | free, *pairs])
    return out


def anchors(half: Column) -> Column:
    """All anchors within 2 bits of a half word (a long below 2**32)."""
    masks = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
    syndrome = F.lit(0)
    for k, m in enumerate(masks):
        syndrome = syndrome + F.bit_count(half.bitwiseAND(F.lit(m))) % 2 * (1 << k)
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in _corrections()])
    return F.transform(F.element_at(table, syndrome + 1), lambda m: half.bitwiseXOR(m))


def _stars(keys: np.ndarray, fps: np.ndarray, reps: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """For rows sorted by key: star edges of the connected groups in each run."""
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    left, right = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = b - a
        if n < 2:
            continue
        if n == 2:
            if (int(fps[a]) ^ int(fps[a + 1])).bit_count() <= threshold:
                left.append(int(reps[a]))
                right.append(int(reps[a + 1]))
            continue
        rest_f, rest_r = fps[a:b], reps[a:b]
        while len(rest_f) > 1:
            centre, queue = int(rest_r[0]), [rest_f[0]]
            rest_f, rest_r = rest_f[1:], rest_r[1:]
            while queue and len(rest_f):
                near = np.bitwise_count(rest_f ^ queue.pop()) <= threshold
                if near.any():
                    queue.extend(rest_f[near])
                    left.extend([centre] * int(near.sum()))
                    right.extend(rest_r[near].tolist())
                    rest_f, rest_r = rest_f[~near], rest_r[~near]
    return left, right


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Star edges ``a``, ``b`` between ``rep`` values that connect exactly the
    fingerprints linked by chains of at most ``threshold`` differing bits.

    ``distinct``: ``fp``, ``rep`` with one row for each fingerprint.
    """
    if not 0 <= threshold < 6:  # one half differs in at most threshold // 2 <= 2 bits
        raise ValueError("thresholds up to 5 bits are covered")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    keys = F.concat(
        F.transform(anchors(low), lambda x: x),
        F.transform(anchors(high), lambda x: x.bitwiseOR(F.lit(1 << 32))),
    )
    spread = distinct.select(F.explode(keys).alias("anchor"), "fp", "rep")
    # counted with partial sums and joined, so that no task holds a whole anchor
    sizes = spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = spread.join(sizes.hint("shuffle_hash"), "anchor").select("anchor", "fp", "rep", "n")
    slices = F.ceil(F.col("n") / CELL).cast("int")
    own = F.pmod(F.xxhash64("fp"), slices).cast("int")
    cells = F.when(slices == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), slices - 1), lambda o: F.least(o, own) * slices + F.greatest(o, own))
    )
    dealt = met.select("anchor", F.explode(cells).alias("cell"), "fp", "rep")
    dealt = dealt.repartition(F.col("anchor"), F.col("cell")).sortWithinPartitions("anchor", "cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(k, f, r):
            left, right = _stars(k, f, r, threshold)
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            key = cols[0] * np.int64(1_000_003) + cols[1]
            now = (key, cols[2].view(np.uint64), cols[3])
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            if not len(now[0]):
                continue
            last = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if now[0][0] != now[0][-1] else 0
            if last:
                yield out(*(x[:last] for x in now))
            held = tuple(x[last:] for x in now)
        if held is not None:
            yield out(*held)

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """One row for each input row: ``doc_id``, ``fp``, ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, its own
    included. Null and empty texts have fingerprint zero and link like any
    other; a text with fewer words than a shingle has one shingle. Exact
    copies and repeated rows share a fingerprint, are compared once, and get
    the same component. A null ``doc_id`` never names a component but links
    like any other; a group that has only null ids gets a null one. Other
    columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words))
    return _grouped(prints, threshold).select("doc_id", "fp", "component_id")


def _grouped(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``prints`` (``doc_id``, ``fp``) with ``group``, the smallest fingerprint
    reachable over links, and ``component_id``."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = materialise(links(distinct.select("fp", F.col("fp").alias("rep")), threshold))
    groups = connected_components(found)
    to = materialise(distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("group")))
    release(found)
    named = to.groupBy("group").agg(F.min("rep").alias("component_id"))
    return prints.join(to.select("fp", "group"), "fp").join(named, "group")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, all columns: that with the
    smallest id, nulls last, and of different texts under it any one, always the
    same. Rows are told apart by id and text, so null and repeated ids lose
    nothing else."""
    (own,) = free_names(docs, "__key")
    keyed = docs.select(row_key("doc_id", "text").alias("__key"), "doc_id", "text")
    prints = materialise(fingerprints(keyed, "__key").select(F.col("doc_id").alias("__key"), "fp"))
    groups = _grouped(prints.select("__key", "fp", F.lit(None).cast("long").alias("doc_id"))).select("__key", "group")
    ids = keyed.select("__key", "doc_id").distinct()
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__key"))
    keep = groups.distinct().join(ids, "__key").groupBy("group").agg(F.min(place).alias("kept")).select(F.col("kept.__key").alias("__key"))
    return docs.withColumn(own, row_key("doc_id", "text")).join(keep.toDF(own), own, "left_semi").dropDuplicates([own]).drop(own)
