"""SimHash near-duplicates by anchor-point covering (operator 7).

Two fingerprints within ``threshold`` bits agree, in at least one of a few
disjoint blocks of bits, up to threshold // blocks bits. For each block a linear
covering code gives the anchors (codewords): every block value has one home
anchor within the covering radius R, and any value within t bits of it is within
R + t of that anchor. So each distinct fingerprint is replicated to all anchors
within R + t of it, in each block, and each anchor compares those at home there
with all that came. Codes are longer for more fingerprints, so that few meet by
chance; the links do not depend on the choice.

Copies are joined to one row per fingerprint first, so a group of copies costs
nothing. Within an anchor only a spanning forest of the links leaves the task,
never all pairs; an anchor over ``hot`` rows is cut into a grid of parts.

Edge cases: null, empty or wordless texts have fingerprint 0; fewer words than a
shingle form one shingle; a bit set in exactly half the shingles (a tie) is 0;
repeated rows share fingerprint and component, and of rows with one doc_id
``keep_one`` keeps one; a null doc_id never names a component unless all are null;
texts of any length are read whole; an empty table gives no rows; further columns of
the input stay in ``keep_one`` and are ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.llm.batches import free_name, map_arrow, slices, utf8
from gridcells.operators.components import connected_components
from gridcells.runtime import shuffle_partitions, spread, staged, table

WORDS, SEED, THRESHOLD = 4, 42, 4
#: Rows of one anchor compared in one go; rows of a group of anchors.
HOT_ROWS, GROUP_ROWS = 20_000, 60_000
#: Hot anchors whose list may go to all tasks (two arrays, 16 bytes each anchor).
HOT_ANCHORS = 1_000_000
#: Bits of an anchor in the one number that it makes with its block.
ANCHOR_BITS = 40


def fingerprint(text: bytes, n_words: int = WORDS) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[n_words - 1 :])]) if len(w) >= n_words else digest(joined, SEED)
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(bits[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(bits), 65536))
    return int(np.packbits(ones * 2 > len(bits)).view(">u8")[0])


def fingerprints(docs: DataFrame, n_words: int = WORDS, row: str | None = None) -> DataFrame:
    """row_id (column ``row``, or new numbers), doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, n_words) for t in utf8(batch)], np.uint64)
            yield {"row_id": batch.column("row_id"), "doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)}

    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(number.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, run, "row_id long, doc_id long, fp long")


@dataclass(frozen=True)
class Block:
    """Bits shift .. shift + width of a fingerprint under a linear code, given by
    the syndrome (a column of the parity check) of each bit; compared up to t."""

    shift: int
    width: int
    columns: tuple[int, ...]
    radius: int
    t: int


def golay(shift: int, t: int) -> Block:
    """The perfect Golay code of length 23: radius 3, 4096 anchors."""
    columns, x = [], 1
    for _ in range(23):
        columns.append(x)
        x <<= 1
        if x >> 11:
            x ^= 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
    return Block(shift, 23, tuple(columns), 3, t)


def hamming(shift: int, width: int, r: int, t: int) -> Block:
    """The perfect Hamming code of length 2**r - 1 on the first bits, all values
    of the others: radius 1."""
    n = (1 << r) - 1
    return Block(shift, width, tuple(range(1, n + 1)) + (0,) * (width - n), 1, t)


def covering(n_fingerprints: int, threshold: int = THRESHOLD) -> list[Block]:
    """Disjoint blocks over 64 bits for that many distinct fingerprints."""
    if n_fingerprints <= 1 << 21:
        t = threshold // 3
        return [golay(0, t), golay(23, t), hamming(46, 18, 4, t)]
    if n_fingerprints <= 1 << 27:
        t = threshold // 3
        return [hamming(0, 22, 4, t), hamming(22, 21, 4, t), hamming(43, 21, 4, t)]
    return [hamming(0, 32, 5, threshold // 2), hamming(32, 32, 5, threshold // 2)]


@lru_cache(maxsize=8)
def _patterns(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """By syndrome: start and count in the list of error patterns up to
    R + t bits, lightest first; and byte tables of syndromes."""
    found: dict[int, list[int]] = {}
    for weight in range(block.radius + block.t + 1):
        for bits in combinations(range(block.width), weight):
            s = 0
            for b in bits:
                s ^= block.columns[b]
            found.setdefault(s, []).append(sum(1 << b for b in bits))
    n = max(found) + 1
    counts = np.array([len(found.get(s, ())) for s in range(n)])
    tables = []
    for low in range(0, block.width, 8):
        own = np.zeros(256, np.int64)
        for value in range(256):
            for b in range(8):
                if value >> b & 1 and low + b < block.width:
                    own[value] ^= block.columns[low + b]
        tables.append(own)
    return np.cumsum(counts) - counts, counts, np.array([p for s in range(n) for p in found.get(s, ())], np.uint64), tables


def anchors(fps: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether it is the row's home, for every anchor within
    R + t of the block's bits."""
    values = (fps >> np.uint64(block.shift)) & np.uint64((1 << block.width) - 1)
    starts, counts, patterns, tables = _patterns(block)
    s = np.zeros(len(fps), np.int64)
    for i, own in enumerate(tables):
        s ^= own[((values >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64)]
    n = counts[s]
    rows = np.repeat(np.arange(len(fps)), n)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    return rows, values[rows] ^ patterns[starts[s][rows] + nth], nth == 0


def forest(home: np.ndarray, near: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``home`` and ``near`` (distinct fingerprints, home is in
    near or not) within the threshold, reduced to star edges of the components
    they form here."""
    nodes = np.unique(np.concatenate([home, near]))
    label = np.arange(len(nodes))
    at_near, at_home = np.searchsorted(nodes, near), np.searchsorted(nodes, home)
    step = max(1, (1 << 21) // max(1, len(near)))
    for i in range(0, len(home), step):
        close = np.bitwise_count(home[i : i + step, None] ^ near[None]) <= threshold
        for k in np.flatnonzero(close.sum(1) > 0):
            met = np.append(at_near[close[k]], at_home[i + k])
            labels = np.unique(label[met])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def links(nodes: DataFrame, blocks: list[Block], n_nodes: int, threshold: int = THRESHOLD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """a, b: a spanning forest, anchor by anchor, of all links between the
    distinct fingerprints of ``nodes`` (fp)."""
    spark = nodes.sparkSession

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k, block in enumerate(blocks):
                _, anchor, _ = anchors(batch.column("fp").to_numpy().view(np.uint64), block)
                key, n = np.unique(anchor, return_counts=True)
                yield {"block": np.full(len(key), k), "anchor": key.astype(np.int64), "n": n}

    each = sum(int(np.ceil(_patterns(b)[1].max())) for b in blocks)
    hot_rows = max(hot_rows, n_nodes * each // HOT_ANCHORS)  # so the hot are HOT_ANCHORS at most
    hot = map_arrow(nodes.select("fp"), sizes, "block int, anchor long, n long").groupBy("block", "anchor").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows)
    found = sorted((r["block"] << ANCHOR_BITS | r["anchor"], -(-r["n"] // hot_rows)) for r in hot.collect())
    parts = spark.sparkContext.broadcast(tuple(np.array([x[i] for x in found], np.int64) for i in (0, 1)))
    n_groups = max(shuffle_partitions(spark), -(-n_nodes * each // GROUP_ROWS))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            all_fps = batch.column("fp").to_numpy().view(np.uint64)
            for low in range(0, len(all_fps), 4096):
                fps = all_fps[low : low + 4096]
                for k, block in enumerate(blocks):
                    row, anchor, home = anchors(fps, block)
                    for fp, a, h, cell in _dealt(k, fps[row], anchor, home, parts.value):
                        group = (a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 7919) + cell.astype(np.uint64) * np.uint64(104729)) >> np.uint64(20)
                        yield {"grp": (group % np.uint64(n_groups)).astype(np.int32), "block": np.full(len(fp), k, np.int8), "anchor": a.astype(np.int64), "cell": cell, "fp": fp.view(np.int64), "home": h.astype(np.int8)}

    def compare(rows: pa.Table) -> pa.Table:
        keys = [rows.column(c).to_numpy() for c in ("block", "anchor", "cell")]
        fps, home = rows.column("fp").to_numpy().view(np.uint64), rows.column("home").to_numpy()
        order = np.lexsort(keys)
        change = np.zeros(len(order), bool)
        change[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        found = [(np.zeros(0, np.uint64),) * 2]
        for own in np.split(order, np.flatnonzero(change)):
            if len(own) > 1:
                found.append(forest(fps[own][home[own] > 0], fps[own][home[own] < 2], threshold))
        return pa.table({n: pa.array(np.concatenate(x).view(np.int64)) for n, x in zip("ab", zip(*found, strict=True), strict=True)})

    dealt = map_arrow(nodes.select("fp"), replicate, "grp int, block byte, anchor long, cell int, fp long, home byte")
    return dealt.groupBy("grp").applyInArrow(compare, "a long, b long")


def _dealt(k: int, fps: np.ndarray, anchor: np.ndarray, home: np.ndarray, parts: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """Rows of (fp, anchor, role, cell). Role 0 compares as a guest, 1 as both, 2
    at home only; a hot anchor's rows go to a row or column of a grid of cells."""
    keys = anchor.astype(np.int64) | np.int64(k << ANCHOR_BITS)
    at = np.minimum(np.searchsorted(parts[0], keys), max(0, len(parts[0]) - 1))
    hot = parts[0][at] == keys if len(parts[0]) else np.zeros(len(keys), bool)
    yield fps[~hot], anchor[~hot], home[~hot].astype(np.int8), np.zeros(int((~hot).sum()), np.int32)
    for rows, role in ((np.flatnonzero(hot), 0), (np.flatnonzero(hot & home), 2)):
        n = parts[1][at[rows]]
        own = ((fps[rows] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) % n
        row, n, own = np.repeat(rows, n), np.repeat(n, n), np.repeat(own, n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts[1][at[rows]]) - parts[1][at[rows]], parts[1][at[rows]])
        # as a guest all rows of its column, at home all columns of its row
        cells = nth * n + own if role == 0 else own * n + nth
        yield fps[row], anchor[row], np.full(len(row), role, np.int8), cells.astype(np.int32)


def components(fps: DataFrame, threshold: int = THRESHOLD, blocks: list[Block] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """fp, component_id (least doc_id that links reach) for each distinct
    fingerprint of ``fps`` (row_id, doc_id, fp), and keeper: the row_id of the
    first row (by doc_id, then row_id) of the component."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    nodes = staged(fps.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    n = nodes.count()
    edges = links(nodes, blocks or covering(n, threshold), n, threshold, hot_rows)
    labels = connected_components(edges)
    grouped = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    grouped = staged(grouped, "grouped")
    least = grouped.groupBy("component").agg(F.min("first").alias("least"))
    return grouped.join(least, "component").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row_id").alias("keeper"))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, n_words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint, component_id per row of ``docs``."""
    fps = staged(fingerprints(docs, n_words), "fps")
    found = fps.join(components(fps, threshold).select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, n_words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without all but the first document of each component. The
    rows are numbered once, in a written copy; those to go are written too, so Spark
    knows their size when it chooses the join."""
    row = free_name(docs, "row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    fps = staged(fingerprints(numbered, n_words, row), "fps")
    found = components(fps, threshold).select("fp", "keeper")
    gone = staged(fps.join(found, "fp").where("row_id <> keeper").select(F.col("row_id").alias(row)), "gone")
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op7_simhash_anchors": op7_simhash_anchors}
SQL: dict[str, str] = {}
