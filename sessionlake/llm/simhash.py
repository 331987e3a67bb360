"""SimHash near-duplicates through an inverted index over byte positions.

1. A text's fingerprint: bit i is 1 if it is set in over half of the hashes of the text's shingles.
2. Fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they
   share at least 5 positional bytes. The index posts a fingerprint under sets of four
   positions and their bytes. Four positions whose numbers XOR to 0 make 14 sets, and
   every 5 positions hold at least one of them, so such a pair meets in a posting list. A list of
   four bytes stays short where the list of one byte would hold a 256th of everything.
3. In a posting list, shared positional bytes are tallied for each pair; pairs that reach
   5 are verified by their differing bits. A long list is cut into blocks, and
   each pair of blocks is a task's work. Of the links found at once only as many leave the
   task as connect the same fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.columns import joined_evenly
from sessionlake.llm.components import components
from sessionlake.workspace import scratch, written

SEED = 42
BYTES = 8
#: Sets of four positions, such that any five positions hold one of them whole.
POSITIONS = [p for p in combinations(range(BYTES), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
#: Differing bits of a link, at most; the index is complete up to 3.
MOST_BITS = 3
BLOCK = 2048
HASHES_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 21


def fingerprint(text: bytes, width: int) -> int:
    """The fingerprint of one text, shingle by shingle; without words it is 0."""
    words = text.lower().split()  # of bytes, both know ASCII only
    width = min(width, len(words))
    if not width:
        return 0
    told = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    n, counts = len(words) - width + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        upto = min(at + HASHES_AT_ONCE, n)
        hashes = [xxhash.xxh64_intdigest(told[a:b - 1], SEED)
                  for a, b in zip(starts[at:upto], ends[at + width - 1:upto + width - 1])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t or b"", width) for t in texts], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def postings(fp: Column) -> Column:
    """The keys of a fingerprint: the number of the set of positions, and the bytes there."""
    def byte(p: int, to: int) -> Column:
        return F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")), 8 * to)

    keys = []
    for i, own in enumerate(POSITIONS):
        key = F.lit(i << 32).cast("long")
        for to, p in enumerate(own):
            key = key.bitwiseOR(byte(p, to))
        keys.append(key)
    return F.array(*keys)


def shared_bytes(differing: np.ndarray) -> np.ndarray:
    """How many positional bytes two fingerprints share, from their XOR."""
    x = differing
    for shift in (4, 2, 1):
        x = x | (x >> np.uint64(shift))
    return BYTES - np.bitwise_count(x & np.uint64(0x0101010101010101))


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (u, v) do, one for each node but the first of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        if not (open_ := la != lb).any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    tied = label != np.arange(len(nodes))
    return nodes[tied], nodes[label[tied]]


def _partners(key: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that are sorted by unit and side: each row's first partner and the end of them.
    In a unit of one side all later rows are partners, else those of the other side."""
    n = len(key)
    new_unit = np.append(True, (key[1:] != key[:-1]).any(1)) if n else np.zeros(0, bool)
    unit = np.cumsum(new_unit) - 1
    begins = np.flatnonzero(new_unit)
    end = np.append(begins[1:], n)[unit]
    crossed = key[:, 1] != key[:, 2]
    on_first = crossed & (side == key[:, 1])
    second = np.zeros(len(begins), dtype=np.int64)
    np.add.at(second, unit[on_first], 1)
    first = np.where(crossed, (begins + second)[unit], np.arange(n) + 1)
    return first, np.where(crossed & ~on_first, first, end)


def _linked(batches: Iterator[pa.RecordBatch], most_bits: int) -> Iterator[pa.RecordBatch]:
    """Links between the fingerprints of each unit (key, i, j); a unit may span batches."""
    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        fp = rows.column("fp").to_numpy().view(np.uint64)
        first, end = _partners(key, rows.column("side").to_numpy())
        n = end - first
        upto = np.cumsum(n)
        at = 0
        while at < len(n):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            own = np.repeat(np.arange(at, stop), n[at:stop])
            other = np.arange(len(own)) - np.repeat(np.append(0, np.cumsum(n[at:stop])[:-1]), n[at:stop]) + first[own]
            differing = fp[own] ^ fp[other]
            enough = np.flatnonzero(shared_bytes(differing) >= BYTES - most_bits)
            near = enough[np.bitwise_count(differing[enough]) <= most_bits]
            if len(near):
                u, v = spanning(fp[own[near]].view(np.int64), fp[other[near]].view(np.int64))
                yield pa.RecordBatch.from_pydict({"u": u, "v": v})
            at = stop

    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        whole = np.flatnonzero((key != key[-1]).any(1)) if len(key) else np.zeros(0, int)
        if len(whole):  # rows of the last unit wait for the next batch
            yield from done(held.slice(0, int(whole[-1]) + 1))
            held = held.slice(int(whole[-1]) + 1)
    if held is not None and held.num_rows:
        yield from done(held)


def links(fingerprints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (fp) with at most `most_bits` differing
    bits: every such pair is compared, and enough links are returned to join them."""
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"the index finds pairs of at most {MOST_BITS} differing bits")
    posted = written(fingerprints.select("fp", F.explode(postings(F.col("fp"))).alias("key")), "postings")
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = posted.join(lists, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("side")
    dealt = met.select("key", "fp", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    units = dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "fp")
    together = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return written(together.mapInArrow(lambda b: _linked(b, most_bits), "u long, v long"), "links")


def near_duplicates(
    docs: DataFrame, width: int = 3, most_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Group documents whose fingerprints over `width`-word shingles, repeats included,
    differ in at most `most_bits` bits, directly or through others.

    Returns per row of docs: doc_id, fp (the fingerprint as a long), component_id (smallest id
    reachable, itself included). A text with fewer words than `width` is one shingle; null
    texts and texts without words have fingerprint 0, which is linked like any other. A
    row without an id takes part; component_id is null where no row of the component
    has one. Rows that repeat are one group; an empty table gives an empty result. Other
    columns of docs are not looked at. The result is a table of its own.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    with scratch(docs.sparkSession):
        found = written(rows.mapInArrow(lambda b: _fingerprints(b, width), "doc_id long, fp long"), "fingerprints")
        nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
        label = components(links(nodes, most_bits)).withColumnRenamed("node", "fp")
        placed = nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        named = placed.groupBy("label").agg(F.min("least").alias("component_id"))
        of_fp = written(placed.join(named, "label").select("fp", "component_id", "n"), "classes")
        return written(joined_evenly(found, of_fp, "fp", "n"), "groups", lasting=True)
