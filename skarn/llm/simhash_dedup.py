"""Near-duplicate groups of texts by 64-bit SimHash fingerprints, compared in bit-sliced form.

Distinct fingerprints are put into buckets by every pair of six bit blocks: if two fingerprints differ
in at most four bits, at least two of the six blocks agree, so they share a bucket (exact, no cap).
Within a bucket the bit planes of 64 fingerprints at a time are stored vertically, one machine word a
plane; a query's distances to all 64 are updated plane by plane in carry-save counters, and a block is
abandoned once all its distances exceed the radius. A bucket larger than ``cell`` is cut into a grid
of cells by hash, each pair of cells a task of its own, so that no task holds an unbounded bucket.

Defined results: null and empty texts have fingerprint 0 and link like any other; texts of any length
are hashed whole, in memory that grows with the one text; repeated rows each get a row; a null id never
names a component unless all its rows have null ids; an empty table gives an empty result; extra columns
of the input are ignored, whatever their names. Ids may be of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.common import arrow_map, components, discard, materialise, meet, raw_texts, ship

BLOCKS = 6
#: For each byte value: its eight bits (most significant first) as the eight bytes of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view("<u8").ravel()


def fingerprint(raw: bytes, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, unsigned."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_digest
    if n <= width:
        return int.from_bytes(digest(text, seed), "big")
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - width + 1].tolist()
    hashes = b"".join([digest(text[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())])
    lanes = _LANES[np.frombuffer(hashes, np.uint8).reshape(-1, 8)]
    m, counts = len(lanes), np.zeros(64, np.int64)
    for k in range(0, m, 255):  # byte counters hold up to 255
        counts += np.add.reduce(lanes[k : k + 255], axis=0, dtype=np.uint64).view(np.uint8)
    return int.from_bytes(np.packbits(2 * counts > m).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp, digest): fp is the fingerprint as a signed long, digest a hash of the text that tells rows of one id apart."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(x, width) for x in raw_texts(batch)], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64), "digest": batch.column("digest")}

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    return arrow_map(slim, run, f"doc_id {dict(docs.dtypes)[id_col]}, fp long, digest long")


def masks(blocks: int = BLOCKS, agree: int = 2) -> list[int]:
    """Signed masks of every choice of ``agree`` of the bit blocks."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    ones = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]
    return [(m := sum(c)) - ((m >> 63) << 64) for c in combinations(ones, agree)]


def planes(blocks: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints: (n, 64) words to (64 planes, n)."""
    lane = np.arange(64, dtype=np.uint64)
    return np.stack([np.bitwise_or.reduce(((blocks >> np.uint64(j)) & np.uint64(1)) << lane, axis=1) for j in range(64)])


def within(queries: np.ndarray, cut: np.ndarray, at: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """For each query a mask of the lanes of block ``at`` within the radius (at most 6); cut: bit planes."""
    out, live = np.zeros(len(queries), np.uint64), np.arange(len(queries))
    q, b, full = queries, at, ~np.uint64(0)
    ones, twos, fours = (np.zeros(len(q), np.uint64) for _ in range(3))
    over = ~valid[b]
    for j in range(64):
        x = cut[j][b] ^ (np.uint64(0) - ((q >> np.uint64(j)) & np.uint64(1)))
        carry, ones = ones & x, ones ^ x
        carry, twos = twos & carry, twos ^ carry
        carry, fours = fours & carry, fours ^ carry
        over = over | carry  # eight or more
        reached = full  # counts grow by one at most, so each passes radius + 1 itself
        for bit, word in ((1, ones), (2, twos), (4, fours)):
            if (radius + 1) & bit:
                reached = reached & word
        over = over | reached
        if j % 8 == 7:
            keep = np.flatnonzero(over != full)
            if len(keep) < 0.7 * len(over):
                live, q, b, ones, twos, fours, over = (v[keep] for v in (live, q, b, ones, twos, fours, over))
                if not len(live):
                    return out
    out[live] = ~over
    return out


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked members one label, the smallest, in place."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(labels, high, low)
        while True:
            down = labels[labels]
            if (down == labels).all():
                break
            labels[:] = down


def link_runs(fps: np.ndarray, runs: np.ndarray, radius: int = 4, chunk: int = 1 << 15) -> np.ndarray:
    """Labels (index of the smallest linked member of the same run); fps: uint64, runs: ids in order."""
    n = len(fps)
    labels = np.arange(n)
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    sizes = np.diff(np.r_[starts, n])
    per_run = -(-sizes // 64)
    first_block = np.cumsum(per_run) - per_run
    run_of = np.repeat(np.arange(len(starts)), sizes)
    offset = np.arange(n) - starts[run_of]
    block_of, lane_of = first_block[run_of] + offset // 64, offset % 64
    m = int(per_run.sum())
    grid, member = np.zeros((m, 64), np.uint64), np.full((m, 64), -1, np.int64)
    grid[block_of, lane_of], member[block_of, lane_of] = fps, np.arange(n)
    valid = np.bitwise_or.reduce((member >= 0).astype(np.uint64) << np.arange(64, dtype=np.uint64), axis=1)
    cut = planes(grid)
    # a query meets its own block and all later ones of its run; runs of one have nothing to meet
    todo = np.where(sizes[run_of] > 1, (first_block + per_run)[run_of] - block_of, 0)
    edge = np.r_[0, np.cumsum(todo)]
    for k in range(0, int(edge[-1]), chunk):
        t = np.arange(k, min(k + chunk, int(edge[-1])))
        q = np.searchsorted(edge, t, side="right") - 1
        b = block_of[q] + (t - edge[q])
        lab = np.where(member >= 0, labels[member], -1) if k == 0 or changed else lab
        top = lab.max(axis=1)
        one = np.where(lab >= 0, lab, top[:, None]).min(axis=1) == top
        open_ = ~(one[b] & (top[b] == labels[q]))  # whole block already in the query's group
        q, b = q[open_], b[open_]
        near = within(fps[q], cut, b, valid, radius)
        hit = np.flatnonzero(near)
        bits = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        before = labels.copy()
        merge(labels, q[hit][row], member[b[hit][row], lane])
        changed = bool((before != labels).any())
    return labels


def _link_partition(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def flush(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            labels = link_runs(fps.view(np.uint64), keys, radius)
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([pa.array(fps[labels[moved]]), pa.array(fps[moved])], schema=schema)

        keys, fps, n = [], [], 0  # whole runs are compared once some thousand rows have come
        for batch in batches:
            keys.append(batch.column("run").to_numpy())
            fps.append(batch.column("fp").to_numpy())
            n += batch.num_rows
            if n >= 8192:
                k, f = np.concatenate(keys), np.concatenate(fps)
                last = int(np.searchsorted(k, k[-1]))
                if last:
                    yield flush(k[:last], f[:last])
                keys, fps, n = [k[last:]], [f[last:]], 0
        if keys and len(k := np.concatenate(keys)):
            yield flush(k, np.concatenate(fps))

    return run


def buckets(classes: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, i, k, n): each fingerprint in every bucket that it shares with another one; n: the bucket's size. Written once."""
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError(f"two of {BLOCKS} blocks agree only up to radius {BLOCKS - 2}")
    keyed = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks())])).alias("b")).select(
        "fp", "b.i", "b.k"
    )
    sizes = keyed.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return materialise(keyed.join(sizes, ["i", "k"]), "buckets")


def linked(met: DataFrame, radius: int = 4, cell: int = 4096) -> DataFrame:
    """Links (u, v) that join all fingerprints of buckets() within the radius."""
    ship(met.sparkSession)
    small = met.where(F.col("n") <= cell).select("fp", F.xxhash64("i", "k", F.lit(0), F.lit(0)).alias("run"))
    # cells of a large bucket: each member goes once to every pair of cells that holds its own
    parts = F.ceil(F.col("n") / cell).cast("long")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), parts)
    large = (
        met.where(F.col("n") > cell)
        .select("fp", "i", "k", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
        .select("fp", F.xxhash64("i", "k", F.least("own", "other") + 1, F.greatest("own", "other") + 1).alias("run"))
    )
    n = max(1, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = small.union(large).repartition(n, "run").sortWithinPartitions("run", "fp")
    return dealt.mapInArrow(_link_partition(radius), "u long, v long").distinct()


def links(classes: DataFrame, radius: int = 4, cell: int = 4096) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that join all that are within the radius."""
    return linked(buckets(classes, radius), radius, cell)


def grouped(fps: DataFrame, radius: int, cell: int) -> DataFrame:
    """(fp, root, n) of each distinct fingerprint of fingerprints(): its component and how many rows hold it. Written once."""
    classes = materialise(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "classes")
    met = buckets(classes.select("fp"), radius)
    nodes = components(linked(met, radius, cell))
    out = materialise(classes.join(nodes, classes.fp == nodes.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "n"), "roots")
    discard(classes, met)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, cell: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    fps = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    roots = grouped(fps, radius, cell)
    rows, classes = roots.agg(F.sum("n"), F.count(F.lit(1))).first()
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp").select("fp", "root", "least", F.col("n").alias("rows"))
    lowest = least.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    by_class = materialise(meet(least.select("fp", "root", "rows"), lowest, "root", classes).select("fp", "component_id", F.col("rows").alias("n")), "lowest")
    return meet(fps.select("doc_id", "fp"), by_class, "fp", rows or 0).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = 4, radius: int = 4, cell: int = 4096) -> DataFrame:
    """One row of each group of near duplicates, with all columns: that of the smallest id, rows without an id last.

    Rows are told apart by id and text, so ids may repeat or lack: of rows of one id the one of the smallest
    text hash stays, and of rows equal in both any one.
    """
    own = "_text"
    while own in {c.lower() for c in docs.columns}:
        own = f"_{own}"
    fps = materialise(fingerprints(docs, width=width), "fingerprints")
    roots = grouped(fps, radius, cell)
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    kept = fps.groupBy("fp").agg(F.min(first).alias("o")).join(roots, "fp").groupBy("root").agg(F.min("o").alias("o"))
    kept = materialise(kept.select(F.col("o.doc_id").alias("doc_id"), F.col("o.digest").alias("digest")), "kept")
    again = fps.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a[own] == b["digest"])
    hashed = docs.withColumn(own, F.xxhash64("text"))
    twice = bool(kept.join(again, kept["doc_id"].eqNullSafe(again["doc_id"]) & (kept["digest"] == again["digest"]), "left_semi").limit(1).count())
    discard(fps, roots)
    one = hashed.join(kept.hint("merge"), same(hashed, kept), "left_semi")  # the rows kept grow with the input: never broadcast
    return (one.dropDuplicates(["doc_id", own]) if twice else one).select(docs.columns)
