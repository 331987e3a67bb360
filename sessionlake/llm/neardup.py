"""Near-duplicate documents by SetSketch registers.

1. A text's shingle set becomes registers: for each of M hash functions the
   smallest value of the set, read as an exponential variable and placed on the
   scale floor(1 - log_b x), cut to 0..Q+1. Registers of a union are the maxima,
   and two sets share a register about as often as their Jaccard similarity says.
2. Equal sets form one class, which its smallest id stands for.
3. Classes that share a band of registers meet. Each is paired with one class of that
   band, the one that meets most others, not with all.
4. The numbers of registers that are smaller, equal and larger give, with the set
   sizes, the joint likelihood of a similarity. A pair goes on unless the wanted
   similarity is out of the question (`DOUBT`).
5. The pair is confirmed on full sets, and links are joined to components.
6. Of the classes that were compared with one hub, those that do not lie in its
   component are compared with all others of them, exactly, in blocks of bounded size. So no
   link is lost to step 3, and no pairs are written but links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.components import components
from sessionlake.llm.shingles import blocks, mix, shingle_sets
from sessionlake.workspace import scratch, written

M = 128
#: Registers in a band. A pair of similarity s is missed with (1 - s^4)^32: 5e-8 at 0.8.
BAND = 4
BASE, RATE, Q = 1.001, 20.0, 65534
#: Nats by which the wanted similarity may be less likely than the best one: six standard deviations.
DOUBT = 18.0
REST_BLOCK, MEMBER_BLOCK = 256, 1024

_seeds = mix(np.arange(1, 2 * M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _TIMES = _seeds[:M], _seeds[M:] | np.uint64(1)
_BANDS = mix(np.arange(1, M // BAND + 1, dtype=np.uint64))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M registers for each set; sets must not be empty."""
    values = np.concatenate(sets)
    begin = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), M), dtype=np.uint16)
    for i in range(M):
        least = np.minimum.reduceat((values ^ _XOR[i]) * _TIMES[i], begin)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1)
    return out


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in blocks(texts := batch.column(1).to_pylist()):
            sets = shingle_sets(texts[a:b], width)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            keys, regs, bands = ([None] * (b - a) for _ in range(3))
            if len(have := np.flatnonzero(n)):
                full = [sets[i] for i in have]
                begin = np.cumsum([0] + [len(s) for s in full[:-1]])
                joined = np.concatenate(full)
                sums = np.stack([np.add.reduceat(mix(joined ^ c), begin) for c in _XOR[:2]], 1)
                r = registers(full)
                band = mix(r.view(np.uint64) ^ _BANDS).view(np.int64)
                for k, i in enumerate(have):
                    keys[i], regs[i], bands[i] = sums[k].tobytes(), r[k].tobytes(), band[k]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n),
                pa.array(keys, pa.binary()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
            ], names=["id", "text_hash", "n", "key", "regs", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in blocks(texts := batch.column(1).to_pylist()):
            sets = [s.view(np.int64) for s in shingle_sets(texts[a:b], width)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether a similarity of `least` is plausible, from two rows of registers each."""
    lower, upper = (a < b).sum(1)[:, None], (a > b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    # candidates for the similarity, up to what the sizes allow
    s = np.concatenate([np.broadcast_to(least, top.shape), top * np.linspace(0, 1, 65)], 1)
    s = np.minimum(s, top)

    def p(x):
        return -np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    above, below = p(u - v * s), p(v - u * s)
    equal = np.clip(1 - above - below, 1e-12, 1)
    log = upper * np.log(np.clip(above, 1e-12, 1)) + lower * np.log(np.clip(below, 1e-12, 1))
    log = log + (M - upper - lower) * np.log(equal)
    reach = top[:, 0] >= least - 1e-9
    more = np.where(s >= least - 1e-12, log, -np.inf).max(1)
    return reach & (more >= log.max(1) - DOUBT)


def _plausible(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            col = {n: part.column(n) for n in part.schema.names}
            r = [np.frombuffer(b"".join(col[c].to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb")]
            n = [col[c].to_numpy().astype(np.float64) for c in ("na", "nb")]
            part = part.select(["u", "v", "na", "nb"])
            yield part.filter(pa.array(may_reach(*r, *n, least)))


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v) of classes, those whose full sets are similar enough."""
    def side(i: str, r: str, n: str) -> DataFrame:
        return nodes.select(F.col("id").alias(i), F.col("regs").alias(r), F.col("n").alias(n))

    known = pairs.join(side("u", "ra", "na"), "u").join(side("v", "rb", "nb"), "v")
    likely = written(known.mapInArrow(
        lambda b: _plausible(b, percent / 100), "u long, v long, na long, nb long"), "pairs")
    both = likely.join(sets.select(F.col("id").alias("u"), F.col("s").alias("sa")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("s").alias("sb")), "v")
    shared = both.select("u", "v", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("shared"))
    return shared.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("u", "v")


def _compared(rest: pd.DataFrame, members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the rows of two blocks with different labels, one for each row of
    `rest` and label. Shared shingles are counted by looking each up among the members'."""
    u, v = [], []
    if len(rest) and len(members):
        sizes = members["s"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(members)), sizes)
        tokens = np.concatenate(members["s"].to_numpy())
        order = np.argsort(tokens, kind="stable")
        owner, tokens = owner[order], tokens[order]
        labels, ids = members["label"].to_numpy(), members["id"].to_numpy()
        for x, label, own in zip(rest["id"], rest["label"], rest["s"]):
            begin, end = np.searchsorted(tokens, own), np.searchsorted(tokens, own, side="right")
            n = end - begin
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[at], minlength=len(members))
            linked = (100 * shared >= percent * (sizes + len(own) - shared)) & (labels != label)
            near = np.flatnonzero(linked)
            near = near[np.unique(labels[near], return_index=True)[1]]
            u += [x] * len(near)
            v += ids[near].tolist()
    return pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})


def _across(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components, within the families (hub, id, label, main) of classes that
    were all compared with one hub: those that are not in its component against all,
    exactly, in blocks. Only links leave the blocks."""
    spread = family.groupBy("hub").agg(
        F.count_if(F.col("label") != F.col("main")).alias("n_rest"), F.count(F.lit(1)).alias("n")).where("n_rest > 0 and n > 1")
    grid = written(spread.select(
        "hub", F.ceil(F.col("n_rest") / REST_BLOCK).alias("rest_blocks"), F.ceil(F.col("n") / MEMBER_BLOCK).alias("member_blocks")), "grid")
    family = family.join(grid, "hub")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """One copy of each row in its own block for every block of the other side."""
        placed = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}s"))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)))
        placed = placed.select("hub", "rest_block", "member_block", "id", "label").join(sets, "id")
        return placed.select(*[F.col(c).alias(c) for c in placed.columns])  # new columns for each side

    cell = ["hub", "rest_block", "member_block"]
    rest = dealt(family.where("label <> main"), "rest_block", "member_block").groupBy(*cell)
    members = dealt(family, "member_block", "rest_block").groupBy(*cell)
    return rest.cogroup(members).applyInPandas(lambda r, m: _compared(r, m, percent), "u long, v long")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Group documents whose sets of `width`-word shingles have a Jaccard similarity of
    at least `percent`/100, directly or through others.

    Returns per row of docs: doc_id, n_shingles, component_id (smallest id reachable,
    itself included), kept (whether it is that id), text_hash (xxhash64 of the text).
    A text with fewer words than `width` is one shingle; a null text, or one without
    words, has none and is linked with nothing. A row without an id is its own group:
    component_id is null and it is kept. Rows that share an id and a text share their
    result; rows that share an id but not the text are grouped each by its text. An
    empty table gives an empty result. Other columns of docs are not looked at. The
    result is a table of its own; everything it was worked out from is removed.
    """
    with scratch(docs.sparkSession):
        return written(_grouped(docs, width, percent, id_col, text_col), "groups", lasting=True)


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("text_hash"))
    sketch = written(rows.mapInArrow(
        lambda b: _sketches(b, width), "id long, text_hash long, n long, key binary, regs binary, bands array<long>"), "sketch")
    placed = sketch.where("n > 0 and id is not null")
    class_of = placed.groupBy("key").agg(F.min("id").alias("class"))
    member = written(placed.select("id", "text_hash", "n", "key").join(class_of, "key"), "member")
    heads = member.where("id = class").select("id", "key").distinct()
    # rows may repeat, and one id may stand for two texts: keep each set once
    nodes = written(placed.join(heads, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]), "nodes")
    texts = rows.where("id is not null").select("id", "t")

    bands = nodes.select("id", F.explode("bands").alias("band"))
    meet = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    hits = written(bands.join(meet, "band"), "hits")
    # the class that meets most others is the least changed one of a family, so most of them link to it
    central = hits.groupBy("id").agg(F.sum("size").alias("central"))
    hub = hits.join(central, "id").groupBy("band").agg(
        F.max(F.struct("central", (-F.col("id")).alias("negative"))).alias("h")).select(
        "band", (-F.col("h.negative")).alias("hub"))
    hits = written(hits.join(hub, "band"), "hubs")
    # the only time that texts move
    sets = written(texts.join(hits.select("id").distinct(), "id", "left_semi").mapInArrow(
        lambda b: _sets(b, width), "id long, s array<long>"), "sets")
    star = hits.where("id <> hub").select(F.greatest("id", "hub").alias("u"), F.least("id", "hub").alias("v")).distinct()
    links = written(_links(star, nodes, sets, percent), "near")
    found = components(links)

    label = found.withColumnRenamed("node", "id")
    main = found.select(F.col("node").alias("hub"), F.col("label").alias("main"))
    family = hits.where("size > 2 and id <> hub").select("hub", "id").distinct().join(label, "id", "left").join(main, "hub", "left")
    family = written(family.select(
        "hub", "id", F.coalesce("label", "id").alias("label"), F.coalesce("main", "hub").alias("main")), "family")
    links = written(links.unionByName(_across(family, sets, percent)), "near")
    found = components(links)

    grouped = member.join(found.withColumnRenamed("node", "class"), "class", "left").select(
        "id", "text_hash", "n", F.coalesce("label", "class").alias("component_id"))
    alone = sketch.where("n = 0 or id is null").select("id", "text_hash", "n", F.col("id").alias("component_id"))
    return grouped.unionByName(alone).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
