"""Near-duplicate documents by 64-bit SimHash.

Links are found in an embedding: a fingerprint becomes the vector of bit counts of its 32 two-bit
segments. The Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints. The segments are eight groups of four. Of two vectors within distance 3, at most three
groups are apart, so five are in the same place: a grid with a cell for each choice of five groups
and their counts brings all such pairs together. What meets in a cell is tested by the Manhattan
bound, then by Hamming distance. Two unrelated fingerprints share a cell with a chance of
56 * (3/8)**20 = 1.7e-7.

Only distinct fingerprints enter the grid, however many documents have them. Where only the components
are asked for, each fingerprint is first tested against one lead of its cells, in eight of the cells, which joins
most of a group of near copies by a link for each. Then the fingerprints of each cell that is still of several
groups meet in arrays of BLOCK at most, which give as few links as join the same groups; in a larger cell,
blocks of its largest group meet only blocks of the others. A cell with a crowd of those is dealt out again
first, by the bits that vary in it, in eight groups of which five agree.
"""

from __future__ import annotations

from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farewright.llm.components import components
from farewright.llm.shared import fresh, written

#: Shingles are hashed this many at a time, which bounds the memory for one very long text.
CHUNK = 1 << 16
MAX_DISTANCE = 3
#: Fingerprints of a cell that a task compares at a time, and those outside a cell's largest group that are not
#: yet a crowd.
BLOCK, CROWD = 1024, 1 << 14
#: Groups of which a task remembers how its links have joined them.
MOST_JOINED = 100_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FIELDS = 0x5555555555555555


def fingerprints(text: bytes, shingle: int = 3, tables: int = 1, seed: int = 42) -> list[int]:
    """Signed 64-bit SimHashes of UTF-8 bytes: a bit is 1 if it is set in over half the hashes of the
    text's word shingles, repeats included. Fewer words than a shingle: one hash of them all; no
    words: 0. Tables after the first mix the same hashes anew, which gives independent bits."""
    words = text.translate(_LOWER).split()
    if not words:
        return [0] * tables
    if len(words) < shingle:
        grams, n = iter([b" ".join(words)]), 1
    else:
        n = len(words) - shingle + 1
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(seed))
    counts = np.zeros((tables, 64), np.int64)
    for start in range(0, n, CHUNK):
        h = np.fromiter(hashes, np.dtype("<u8"), min(CHUNK, n - start))
        for t in range(tables):
            counts[t] += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def with_fingerprints(docs: DataFrame, text: str, out: str, shingle: int = 3, tables: int = 1) -> DataFrame:
    """docs without its text, and with the array of fingerprints of each whole text; null counts as
    empty."""

    def run(batches):
        for batch in batches:
            prints = [fingerprints(t or b"", shingle, tables) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints, pa.list_(pa.int64()))], names=[*batch.schema.names[1:], out])

    (raw,) = fresh(docs, "utf8")
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).withColumn(out, F.array().cast("array<bigint>")).schema
    for f in schema.fields:
        f.nullable = True
    return docs.select(F.col(text).cast("binary").alias(raw), *keep).mapInArrow(run, schema)


def _embed(fp: Column) -> Column:
    """The 32 two-bit fields of a long, each holding the bit count of that segment."""
    low = F.lit(_FIELDS)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _manhattan(a: Column, b: Column) -> Column:
    """Of two embedded vectors: fields differ by 1 if they differ in the low bit, else by 2 or 0."""
    d, low = a.bitwiseXOR(b), F.lit(_FIELDS)
    odd, high = d.bitwiseAND(low), F.shiftrightunsigned(d, 1).bitwiseAND(low)
    return F.bit_count(odd) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(odd)))


#: For each choice of five groups, the fields of these groups.
_CELLS = [sum(0xFF << 8 * g for g in five) for five in combinations(range(8), 5)]
_CELLS = [c - (1 << 64) if c >> 63 else c for c in _CELLS]


#: Of these, eight that take each group in turn as their first.
_FEW = [i for i, five in enumerate(combinations(range(8), 5)) if any(set(five) == {(k + j) % 8 for j in range(5)} for k in range(8))]


def _visits(prints: DataFrame, which: list[int] | None = None) -> DataFrame:
    """prints: (t, fp, ...). Each fingerprint in each of its cells (or of those chosen), as a column cell."""
    e = prints.withColumn("e", _embed(F.col("fp")))
    chosen = range(len(_CELLS)) if which is None else which
    cells = F.array(*(F.xxhash64(F.lit(i), "t", F.col("e").bitwiseAND(F.lit(_CELLS[i]))) for i in chosen))
    return e.select(*prints.columns, F.explode(cells).alias("cell"))


def _near(a: Column, b: Column) -> Column:
    return (_manhattan(_embed(a), _embed(b)) <= MAX_DISTANCE) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_DISTANCE)


def links(prints: DataFrame) -> DataFrame:
    """prints: (t, fp), distinct. (t, a, b), a < b: all pairs of fingerprints of a table with 3 or fewer
    differing bits, each once."""
    visits = _visits(prints)
    p, q = visits.alias("p"), visits.alias("q")
    a, b = F.col("p.fp"), F.col("q.fp")
    pairs = p.join(q, (F.col("p.cell") == F.col("q.cell")) & (F.col("p.t") == F.col("q.t")) & (a < b) & _near(a, b))
    return pairs.select("p.t", a.alias("a"), b.alias("b")).distinct()


def _node(t: str, fp: str) -> Column:
    return F.struct(F.col(t).alias("t"), F.col(fp).alias("fp"))


def _led(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """met: (cell, t, fp, node). A cell's lead is that with most others in all its cells; each fingerprint is
    tested against the first of its leads. (links found, one for each two leads or fingerprints; (node, root):
    the lead that each is near, or itself). Groups are parts of components, which costs tests but loses none."""
    sizes = met.groupBy("cell").agg(F.count("*").alias("size"))
    company = met.join(sizes, "cell").groupBy("node").agg(F.sum("size").alias("company"))
    leads = met.join(company, "node").groupBy("cell").agg(F.max(F.struct("company", "t", "fp", "node")).alias("lead"))
    asked = met.join(leads, "cell").where(F.col("t") == F.col("lead.t"))
    first = written(asked.groupBy("node", "t", "fp").agg(F.max("lead").alias("lead")), "leads")
    found = first.where((F.col("node") != F.col("lead.node")) & _near(F.col("fp"), F.col("lead.fp")))
    found = written(found.select(F.col("node").alias("a"), F.col("lead.node").alias("b")), "edges")
    return found, found.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _masks(vary: int) -> list[int]:
    """The bits of a long in eight groups as even as can be; for any five of them, their bits."""
    at = [i for i in range(64) if vary >> i & 1]
    groups = [sum(1 << i for i in at[k::8]) for k in range(8)]
    masks = [sum(five) for five in combinations(groups, 5)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _dealt_again(met: DataFrame) -> DataFrame:
    """The fingerprints of cells in finer ones: of two within 3 bits, five of eight groups of the bits that
    vary in the cell agree."""

    def run(batches):
        for batch in batches:
            masks = [_masks(v & (1 << 64) - 1) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masks, pa.list_(pa.int64()))], names=["cell", "masks"])

    least = met.groupBy("cell").agg(F.min("fp").alias("least"))
    vary = met.join(least, "cell").groupBy("cell").agg(F.bit_or(F.col("fp").bitwiseXOR(F.col("least"))).alias("vary"))
    masks = written(vary.mapInArrow(run, "cell long, masks array<bigint>"), "masks")
    finer = met.join(masks, "cell").select("cell", "t", "fp", "root", F.posexplode("masks").alias("i", "mask"))
    return finer.select(F.xxhash64("cell", "i", F.col("fp").bitwiseAND(F.col("mask"))).alias("cell"), "t", "fp", "root")


def _joined(near: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """near: a symmetric matrix; group: the group of each row. Places of links, as few as join all groups that
    links join."""
    seen, out = np.zeros(int(group.max()) + 1, bool), []
    for first in np.unique(group).tolist():
        if seen[first]:
            continue
        seen[first], queue = True, [first]
        while queue:
            own = np.flatnonzero(group == queue.pop())
            reached = np.flatnonzero(near[own].any(axis=0) & ~seen[group])
            fresh_, at = np.unique(group[reached], return_index=True)
            out += [(int(own[np.argmax(near[own, j])]), int(j)) for j in reached[at]]
            seen[fresh_] = True
            queue += fresh_.tolist()
    return out


def _links_of(t: np.ndarray, fp: np.ndarray, root: np.ndarray, apart: int = 0) -> list[tuple[int, int]]:
    """Places of links among fingerprints of a table that join what all their links of 3 or fewer bits join. root: any
    columns that name their groups. apart: only links between the first so many and the others."""
    group = np.unique(root, axis=0, return_inverse=True)[1].ravel()
    bits = fp.astype(np.uint64)  # bit_count is of the absolute value
    near = (np.bitwise_count(bits[:, None] ^ bits[None, :]) <= MAX_DISTANCE) & (t[:, None] == t[None, :])
    if apart:
        near[:apart, :apart] = near[apart:, apart:] = False
    return _joined(near, group) if (near & (group[:, None] != group[None, :])).any() else []


def _new(of: dict, x: tuple, y: tuple) -> bool:
    """Whether a link between groups x and y says what the task's links before it do not. of: what those joined,
    forgotten when it has grown to MOST_JOINED, which costs links but loses none."""

    def find(x):
        while (y := of.get(x, x)) != x:
            of[x] = x = of.get(y, y)
        return x

    if len(of) >= MOST_JOINED:
        of.clear()
    x, y = find(x), find(y)
    of[x] = y
    return x != y


_LINKS = "x struct<t: int, fp: bigint>, y struct<t: int, fp: bigint>, a struct<t: int, fp: bigint>, b struct<t: int, fp: bigint>"


def _linked(t: np.ndarray, fp: np.ndarray, root: np.ndarray, places: list[tuple[int, int]]) -> pa.RecordBatch:
    """The links (x, y, a, b): of groups x and y, between fingerprints a and b."""
    kind = pa.struct([("t", pa.int32()), ("fp", pa.int64())])
    node = lambda t, fp: pa.StructArray.from_arrays([pa.array(t, pa.int32()), pa.array(fp, pa.int64())], fields=list(kind))
    i, j = np.array(places, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([node(root[i, 0], root[i, 1]), node(root[j, 0], root[j, 1]), node(t[i], fp[i]), node(t[j], fp[j])], names=["x", "y", "a", "b"])


def _in_cells(met: DataFrame) -> DataFrame:
    """(x, y, a, b): links within cells that one task can take."""

    def run(batches):
        held, of = np.zeros((0, 5), np.int64), {}
        for batch in chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
            ends = np.flatnonzero(held[1:, 0] != held[:-1, 0]) + 1
            ends = ends.tolist() + ([len(held)] if batch is None else [])
            start, cells = 0, []
            for end in ends:
                cells += [(start + i, start + j) for i, j in _links_of(held[start:end, 1], held[start:end, 2], held[start:end, 3:])]
                start = end
            if cells := [(i, j) for i, j in cells if _new(of, tuple(held[i, 3:].tolist()), tuple(held[j, 3:].tolist()))]:
                yield _linked(held[:, 1], held[:, 2], held[:, 3:], cells)
            held = held[start:]

    rows = met.select("cell", "t", "fp", F.col("root.t").alias("rt"), F.col("root.fp").alias("rfp"))
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, _LINKS)


def _across(told: DataFrame) -> DataFrame:
    """told: (cell, t, fp, root, odd, n). (x, y, a, b): links within cells in blocks of about BLOCK: those of a cell's
    largest group meet all others, and the others each other."""

    def run(batches):
        for batch in batches:
            for x, y, same in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = np.array([(r["t"], r["fp"], r["root"]["t"], r["root"]["fp"]) for r in (x if same else x + y)], np.int64)
                if places := _links_of(rows[:, 0], rows[:, 1], rows[:, 2:], 0 if same else len(x)):
                    yield _linked(rows[:, 0], rows[:, 1], rows[:, 2:], places)

    block = F.pmod(F.xxhash64("cell", "fp"), F.ceil(F.col("n") / F.lit(BLOCK)).cast("long"))
    blocks = written(told.groupBy("cell", "odd", block.alias("block")).agg(F.collect_list(F.struct("t", "fp", "root")).alias("rows")), "blocks")
    p, q = blocks.where("odd").alias("p"), blocks.alias("q")
    pairs = p.join(q, (F.col("p.cell") == F.col("q.cell")) & (~F.col("q.odd") | (F.col("p.block") <= F.col("q.block"))))
    same = F.col("q.odd") & (F.col("p.block") == F.col("q.block"))
    return pairs.select(F.col("p.rows").alias("x"), F.col("q.rows").alias("y"), same.alias("same")).mapInArrow(run, _LINKS)


def _within(visits: DataFrame, again: bool = True) -> DataFrame:
    """visits: (cell, t, fp, root). (x, y, a, b): links that join what all links within cells join. Cells of
    one group have nothing to add. again: cells of a crowd outside their largest group are dealt again."""
    several = visits.groupBy("cell").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    met = written(visits.join(written(several.select("cell", "n"), "cells"), "cell"), "met")
    found = written(_in_cells(met.where(F.col("n") <= BLOCK)), "links")
    big = met.where(F.col("n") > BLOCK)
    if big.isEmpty():
        return found
    largest = big.groupBy("cell", "root").agg(F.count("*").alias("k")).groupBy("cell").agg(F.max(F.struct("k", "root")).alias("most"))
    odd = F.col("root") != F.col("most.root")
    told = big.join(written(largest, "largest"), "cell").withColumns({"odd": odd, "others": F.col("n") - F.col("most.k")})
    told = written(told.select("cell", "t", "fp", "root", "odd", "others", F.when(F.col("odd"), F.col("others")).otherwise(F.col("most.k")).alias("n")), "told")
    if again:
        crowds = told.where(F.col("others") > CROWD)
        found = found if crowds.isEmpty() else found.unionByName(_within(_dealt_again(crowds), False))
        told = told.where(F.col("others") <= CROWD)
    return found.unionByName(written(_across(told), "links"))


def linked(prints: DataFrame) -> DataFrame:
    """prints: (t, fp), distinct and written. (a, b), structs (t, fp): links of 3 or fewer differing bits that
    join the same components as all such links do, but not all of them."""
    known = prints.select("t", "fp", _node("t", "fp").alias("node"))
    few = _visits(known, _FEW)
    cells = written(few.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell"), "cells")
    edges, of = _led(written(few.join(cells, "cell"), "met"))
    rooted = written(known.join(of, "node", "left").select("t", "fp", F.coalesce("root", "node").alias("root")), "rooted")
    found = _within(_visits(rooted))
    ways = F.struct(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    once = found.groupBy(ways.alias("ways")).agg(F.min(F.struct("a", "b")).alias("l")).select("l.a", "l.b")
    return edges.unionByName(written(once, "joined"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, tables: int = 1) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for each row of docs: xxhash64 of its text, its signed
    fingerprint (of the first table), a name of its component, and the smallest doc_id that links of
    3 or fewer differing bits, in any table, reach.

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any
    other. Repeated rows stay, each with the same answer. A null doc_id is never the smallest; a
    component of nothing else has null. No rows give no rows. Other columns are left out, so their
    names do not matter.

    Nodes are the fingerprints of the first table; those of a document in other tables are tied to
    it by one link each, so a group of copies costs links in the number of its fingerprints."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    rows = written(with_fingerprints(narrow, "text", "fps", shingle, tables).withColumn("fp", F.col("fps")[0]), "simhash")
    firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    if tables == 1:
        found = linked(firsts.select(F.lit(0).alias("t"), "fp"))
        of = components(found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")))
    else:
        node = lambda t, fp: F.struct(F.lit(t).alias("t") if isinstance(t, int) else F.col(t).alias("t"), F.col(fp).alias("fp"))
        each = written(rows.select("fp", F.posexplode("fps").alias("t", "own")).distinct(), "tables")
        near = linked(written(each.select("t", F.col("own").alias("fp")).distinct(), "own_prints"))
        ties = each.where("t > 0").select(node(0, "fp").alias("a"), node("t", "own").alias("b"))
        of = components(near.unionByName(ties))
        of = of.where("node.t = 0").select(F.col("node.fp").alias("node"), F.xxhash64("root").alias("root"))
    named = firsts.join(of.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", F.col("fp") if tables == 1 else F.xxhash64(node(0, "fp"))).alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.join(least, "root").select("fp", "root", "component_id")
    return rows.join(label, "fp").select("doc_id", "th", "fp", "root", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, tables: int = 1) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null last), then the least
    fingerprint and text hash; of rows alike in all of these, any one."""
    found = near_duplicates(docs, doc_id, text, shingle, tables)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "th")
    kept = found.groupBy("root").agg(F.min_by(F.struct(F.xxhash64("doc_id").alias("d"), "th"), order).alias("k"))
    d, th, kd, kth = fresh(docs, "d", "th", "kept_d", "kept_th")
    kept = kept.select(F.col("k.d").alias(kd), F.col("k.th").alias(kth))
    rows = docs.withColumns({d: F.xxhash64(doc_id), th: F.xxhash64(text)})
    return rows.join(kept, (F.col(d) == F.col(kd)) & (F.col(th) == F.col(kth))).dropDuplicates([d, th]).select(*docs.columns)
