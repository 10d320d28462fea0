"""Exact n-gram Jaccard join in the metric space of shingle sets (operator 6).

The Jaccard distance d is a metric.  Two sets are linked if d <= R.  The join returns the
components of the link graph without listing all pairs of a group.

1.  Filter.  Nearly all pairs of sets have distance 1, where no pivot tells anything and every Voronoi cell
    would have to take in every set, so the space is first cut up by a necessary condition.  Sets of a size slot are cut by
    hash into parts, more than the D elements in which two linked sets can differ; so of N non-empty
    parts at least N - D are equal in both.  Parts equal in up to ``FEW`` sets give pairs, whose
    equal parts are counted: fewer than N - D less the set's parts that more sets have, and the
    pair is out.  Sets of which too many parts are common for that to promise anything are joined to
    those parts themselves, and sets with too many empty parts to the prefix of their
    sorted hashes.  The components of that graph are the first regions: no link leaves one.  Of a part
    that many sets of a task have only a few entries travel to the part's bucket, for the others are known to be common there.
2.  Regions with more than ``LEAF`` elements are split by pivots, where that leaves less to do.  Each set goes to the cell of its nearest pivot (Voronoi), and
    also to every cell whose pivot is at most 2R farther, where by the triangle inequality a partner may live.  Sets within
    R of a pivot are linked to it; pivots that share such a set are one group.  A cell with one group alone is done.
    A cell in which one group leaves few others is cut into shares of the group, each
    beside all of the others: two sets of a group need not meet again.  Sets within R of a
    pivot are dropped if no set outside that ball can be within R of them.  The cells are the next regions.
3.  In a region of at most ``LEAF`` elements the same goes on in one task with one pivot at a time:
    links to the pivot, then sets covered by it are dropped unless the windows let a stranger reach them, and a
    pivot whose window holds its own group alone is passed over.
4.  Where most sets are within 3R of each other, windows take nearly all sets into every cell.  Such regions are left whole up to ``BLOCK``
    elements (step 3); larger ones are cut into windows of size, and at last compared in blocks, every pair of blocks in a
    task of its own.

Equal sets take part once.  Sets are those of 64-bit shingle hashes (see ``text``): two different shingles count
as one by a chance of 2**-64; every other step is exact.

Defined results: A-Z are lowered; a text of 1 to 4 words has one shingle, its whole sequence; null text and
text without words have none and stay alone (component_id is the doc_id); rows that
share a doc_id are documents of their own; a null doc_id is left out of the minimum unless its component has no other; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.graph import components, local_roots
from orrery.llm.text import U64, mix, release, shingles, text_blocks, words
from orrery.plans.scratch import passing, small, written

K = 5
#: Links: 100 * intersection >= PERCENT * union; R is the same as a distance.
PERCENT = 80
R = 0.2
SLOT = 1.6
#: Elements of a region that is joined as it is; of one that a task joins because pivots do not shrink it; and that a task
#: measures against the pivots.
LEAF, BLOCK, SHARE = 40_000, 1_000_000, 400_000
#: How many times its elements the cells of a region may hold.
GAIN = 1.5
PIVOTS = 8
LEVELS = 5
NEAR = 0.7
EPS = 1e-9
SMALL = 300_000
FEW = 8
#: Signatures, or rows of groups, that a task holds before it passes them on.
HELD = 500_000
#: The bits of a signature after those of its bucket, with its lowest two; a set's first fingerprint, its node.
ENTRY = np.dtype([("sig", "u1", 5), ("node", "<i8")])
#: What a task has found out by itself: an edge (kind 1) of nodes a and b, or that the part b of node a is common (4 and the parity).
KNOWN = np.dtype([("a", "<i8"), ("b", "<i8"), ("kind", "u1")])


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * inter >= PERCENT * (a + b - inter)


def slot_of(n: int) -> int:
    return int(np.floor(np.log(n) / np.log(SLOT) + 1e-12))


def slot_parts(slot: int) -> int:
    """Parts of a slot: a quarter of its largest set's size, in which linked sets can differ, and some for empty parts."""
    return int(np.ceil(SLOT ** (slot + 1) * 0.3)) + 4


def signatures(s: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Signatures of the parts of a sorted set of hashes, and the number of them by parity of the slot.

    The lowest two bits tell a slot's parity, or 2 for a hash of the prefix.
    """
    n, own, out, count = len(s), slot_of(len(s)), [], [0, 0]
    for slot in {own, slot_of(-(-4 * n // 5))}:
        m = slot_parts(slot)
        part = ((s >> U64(32)) * U64(m)) >> U64(32)
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        found = mix(np.add.reduceat(mix(s ^ U64(0x5851F42D4C957F2D)), begin) + part[begin] * U64(0x2545F4914F6CDD1D) + U64(slot + 1))
        out.append(found & ~U64(3) | U64(slot & 1))
        count[slot & 1] = len(begin)
        # in the slot below its own a set is the larger of two
        if len(begin) < (n // 4 if slot == own else 2 * n // 9) + 1:
            out.append(mix(s[: n - (4 * n + 4) // 5 + 1] + U64(0x1234567 + slot)) & ~U64(3) | U64(2))
    return np.concatenate(out), count


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, as two signed integers."""
    a = int(mix(s + U64(0x9E37)).sum(dtype=U64)) if len(s) else 0
    b = int(mix(s ^ U64(0xC2B2AE3D27D4EB4F)).sum(dtype=U64)) if len(s) else 0
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for i, j, raw, offs in text_blocks(column):
        every, begin = shingles(*words(raw, offs), k)
        for d in range(j - i):
            yield i + d, np.unique(every[begin[d] : begin[d + 1]])


DOCS = [("bucket", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("fa", pa.int64()), ("fb", pa.int64()), ("parts0", pa.int64()), ("parts1", pa.int64()), ("blob", pa.binary()), ("known", pa.binary())]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted values: where each run begins, the run of each value, and its place in the run."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(x))))
    return begin, run, np.arange(len(x)) - begin[run]


def thinned(sig: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A task's signatures and nodes in order, less those of which it knows all there is to know; and that, as KNOWN."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    begin, run, place = _runs(sig)
    star = (sig & U64(3) == U64(2)) & (place > 0)
    common = (sig & U64(3) < U64(2)) & (place > FEW)
    known = np.zeros(int(star.sum() + common.sum()), KNOWN)
    known["a"] = np.concatenate([node[star], node[common]])
    known["b"] = np.concatenate([node[begin[run[star]]], numbers(sig[common], bits)])
    known["kind"] = np.concatenate([np.ones(star.sum(), np.uint8), (U64(4) + (sig[common] & U64(3))).astype(np.uint8)])
    stays = ~(star | common)
    return sig[stays], node[stays], known


def short(sig: np.ndarray, bits: int) -> np.ndarray:
    """The bytes of signatures that travel in a bucket."""
    kept = (sig << U64(bits)) & ~U64((1 << 26) - 1) | (sig & U64(3)) << U64(24)
    return kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]


def numbers(sig: np.ndarray, bits: int) -> np.ndarray:
    """Signatures as they are known after their buckets: the bytes that travel, and the bucket's number."""
    return _number(short(sig, bits)) | (sig >> U64(64 - bits)).astype(np.int64) << 40


def _first(buckets: int, k: int):
    bits = (buckets - 1).bit_length()
    schema = pa.schema(DOCS)

    def packed(docs: list[tuple], sigs: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        """Document rows, a row for each bucket with its entries, and one with what is known."""
        if sigs:
            sig, node, known = thinned(np.concatenate(sigs), np.concatenate(nodes), bits)
            entry = np.empty(len(sig), ENTRY)
            entry["sig"], entry["node"] = short(sig, bits), node
            bucket = (sig >> U64(64 - bits)).astype(np.int64)
            begin = _runs(bucket)[0]
            ends = [*begin[1:].tolist(), len(sig)]
            docs = docs + [(int(bucket[a]), *[None] * 8, entry[a:b].tobytes(), None) for a, b in zip(begin.tolist(), ends, strict=True)]
            if len(known):
                docs.append((docs[0][0], *[None] * 9, known.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*docs, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        docs, sigs, nodes, seen, held = [], [], [], {}, 0
        for batch in batches:
            ids, marks = batch.column(0).cast(pa.int64()).to_pylist(), batch.column(2).to_pylist()
            for r, s in sets_of(batch.column(1), k):
                fa, fb = fingerprints(s)
                if len(s) and (fa, fb) not in seen:
                    sig, seen[fa, fb] = signatures(s)
                    sigs.append(sig)
                    nodes.append(np.full(len(sig), fa, np.int64))
                    held += len(sig)
                docs.append((row % buckets, ids[r], marks[r], row, len(s), fa, fb, *(seen[fa, fb] if len(s) else (0, 0)), None, None))
                row += 1
                if held >= HELD:
                    yield packed(docs, sigs, nodes)
                    docs, sigs, nodes, seen, held = [], [], [], {}, 0
        if docs:
            yield packed(docs, sigs, nodes)
        release()

    return run


def _number(raw: np.ndarray) -> np.ndarray:
    """Big-endian bytes of each row as integers."""
    out = np.zeros(len(raw), np.int64)
    for k in range(raw.shape[1]):
        out = out << 8 | raw[:, k]
    return out


def bucket_groups(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's entries: edges (a, b) by prefix; pairs (a, b, parity) of small groups; (node, signature, parity) of large ones."""
    sig, node = _number(entries["sig"]), entries["node"].astype(np.int64)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])
    sig, node = sig[new], node[new]
    begin, group, _ = _runs(sig)
    size = np.bincount(group, minlength=len(begin))
    kind, many = sig & 3, size[group]
    star = (kind == 2) & (many > 1)
    edges = np.array([node[star], node[begin[group[star]]]])
    pairs = []
    few = (kind < 2) & (many <= FEW)
    for lag in range(1, FEW):
        at = np.flatnonzero(few[:-lag] & (group[:-lag] == group[lag:])) if len(sig) > lag else np.zeros(0, np.int64)
        pairs.append(np.array([node[at], node[at + lag], kind[at]]))
    large = (kind < 2) & (many > FEW)
    return edges[:, edges[0] != edges[1]], np.concatenate(pairs, 1), np.array([node[large], sig[large], kind[large]])


GROUPS = "kind int, doc_id long, mark long, row long, n long, fa long, fb long, parts0 long, parts1 long, a long, b long, parity int, count long"


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows as they are (kind 0); blobs, sorted by bucket, to edges (1), pairs (2) and common parts (3)."""
    held, bucket, edges, pairs = [], None, [], []
    names = [x.split()[0] for x in GROUPS.split(", ")]

    def out(kind: int, a: np.ndarray, b: np.ndarray, parity: np.ndarray | None = None, count: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 50_000):
            to = slice(at, at + 50_000)
            n = len(a[to])
            last = [pa.nulls(n, pa.int32()) if parity is None else pa.array(parity[to].astype(np.int32)), pa.nulls(n, pa.int64()) if count is None else pa.array(count[to])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[pa.nulls(n, pa.int64())] * 8, pa.array(a[to]), pa.array(b[to]), *last], names=names)

    def flush() -> Iterator[pa.RecordBatch]:
        """What the buckets so far have given, repeats put together."""
        if edges:
            yield from out(1, *local_roots(*np.concatenate(edges, 1)))
        if pairs:
            a, b, parity = np.concatenate(pairs, 1)
            order = np.lexsort((parity, b, a))
            a, b, parity = a[order], b[order], parity[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (parity[1:] != parity[:-1])])) if len(a) else np.zeros(0, np.int64)
            yield from out(2, a[new], b[new], parity[new], np.diff(np.concatenate([new, [len(a)]])))
        edges.clear()
        pairs.clear()

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            more, two, common = bucket_groups(np.frombuffer(b"".join(held), ENTRY))
            held.clear()
            edges.append(more)
            pairs.append(two)
            # the bucket's number makes the signature whole
            yield from out(3, common[0], common[1] | bucket << 40, common[2])
            if sum(x.shape[1] for x in pairs) + sum(x.shape[1] for x in edges) > HELD:
                yield from flush()

    for batch in batches:
        docs = batch.filter(pc.is_valid(batch.column(3)))
        if n := docs.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *docs.columns[1:9], *[pa.nulls(n, pa.int64())] * 2, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=names)
        for b, blob, known in zip(batch.column(0).to_pylist(), batch.column(9), batch.column(10), strict=True):
            if known.is_valid:
                x = np.frombuffer(known.as_py(), KNOWN)
                edges.append(np.array([x["a"], x["b"]])[:, x["kind"] == 1])
                more = x[x["kind"] > 1]
                yield from out(3, more["a"], more["b"], more["kind"] & 1)
            if blob.is_valid:
                if b != bucket:
                    yield from close()
                    bucket = b
                held.append(blob.as_py())
    yield from close()
    yield from flush()
    release()


def candidate_edges(both: DataFrame) -> DataFrame:
    """(a, b): a graph on the sets' nodes and common parts, no component of which any link leaves."""
    common = both.where("kind = 3").select(F.col("a").alias("node"), F.col("b").alias("sig"), "parity").distinct()
    common = written(common, "common")
    many = common.groupBy("node").agg(*(F.sum(F.when(F.col("parity") == k, 1).otherwise(0)).alias(f"many{k}") for k in (0, 1)))
    sets = both.where("kind = 0 and n > 0").groupBy(F.col("fa").alias("node")).agg(F.min("n").alias("n"), F.min("parts0").alias("parts0"), F.min("parts1").alias("parts1"))
    left = [(F.col(f"parts{k}") - F.coalesce(f"many{k}", F.lit(0))).alias(f"left{k}") for k in (0, 1)]
    known = written(sets.join(many, "node", "left").select("node", "n", *left), "parts")
    pairs = both.where("kind = 2").groupBy("a", "b", "parity").agg(F.sum("count").alias("count"))
    for side in ("a", "b"):
        mine = known.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), *(F.col(f"left{k}").alias(f"left{k}_{side}") for k in (0, 1)))
        pairs = pairs.join(mine, side)
    rest = F.greatest(*(F.when(F.col("parity") == 0, F.col(f"left0_{s}")).otherwise(F.col(f"left1_{s}")) for s in ("a", "b")))
    differ = F.floor((F.col("n_a") + F.col("n_b")) / 9)
    near = (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (F.col("count") >= rest - differ - 1)
    pairs = pairs.where(near).select("a", "b")
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SLOT)) + 1e-12) % 2
    most = [F.floor(F.when(own == k, F.col("n") / 4).otherwise(2 * F.col("n") / 9)) for k in (0, 1)]
    heavy = known.select("node", F.explode(F.array(*(F.when(F.col(f"left{k}") <= most[k] + 1, F.lit(k)) for k in (0, 1)))).alias("parity")).where("parity is not null")
    # a common part is a node of the graph itself, so no task has to gather the sets that share it
    stars = common.join(heavy, ["node", "parity"]).select(F.col("node").alias("a"), F.xxhash64("sig", "parity").alias("b"))
    return both.where("kind = 1").select("a", "b").union(pairs).union(stars)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, fa, fb = (batch.column(c).to_pylist() for c in range(3))
            out, held, seen = [], 0, set()
            for r, s in sets_of(batch.column(3), k):
                # a doc_id may stand for several texts, and several rows without one for the same
                if fa[r] not in seen and fingerprints(s) == (fa[r], fb[r]):
                    seen.add(fa[r])
                    out.append((fa[r], region[r], len(s), s.tobytes()))
                    held += len(s)
                if held >= HELD:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)
        release()

    return run


SETS = pa.schema([("rep", pa.int64()), ("region", pa.int64()), ("n", pa.int64()), ("elements", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SETS.types, strict=True)], schema=SETS)


def join_region(sets: list[np.ndarray], names: list[int]) -> list[tuple[int, int]]:
    """Links that connect each component of a region, found pivot by pivot; ``names`` label the sets."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), names[i]))
    size = np.array([len(sets[i]) for i in order])
    name = [names[i] for i in order]
    _, token, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    kept = count[token] > 1  # what stands in one set only adds to no intersection
    owner = np.repeat(np.arange(len(order)), size)[kept]
    token = token[kept]
    begin = np.searchsorted(owner, np.arange(len(order) + 1))
    marks = np.zeros(len(count), np.uint8)
    alive = np.ones(len(order), bool)
    group = np.arange(len(order))
    found = []
    for p in range(len(order)):
        if not alive[p]:
            continue
        alive[p] = False
        mine = token[begin[p] : begin[p + 1]]
        reach = size[p] / (1 - 2 * R)
        high = int(np.searchsorted(size, reach + EPS, side="right"))
        back = int(np.searchsorted(size, size[p] * (1 - 2 * R) - EPS))
        if not len(mine) or not (alive[back:high] & (group[back:high] != group[p])).any():
            continue
        marks[mine] = 1
        part = token[begin[back] : begin[high]]
        total = np.concatenate([[0], np.cumsum(marks[part], dtype=np.int64)])
        inter = total[begin[back + 1 : high + 1] - begin[back]] - total[begin[back:high] - begin[back]]
        marks[mine] = 0
        here = alive[back:high]
        link = here & linked(inter, size[back:high], size[p])
        if not link.any():
            continue
        distance = 1 - inter / (size[back:high] + size[p] - inter)
        strange = distance[here & ~link]
        nearest = strange.min() if len(strange) else 2.0
        found += [(name[back + int(i)], name[p]) for i in np.flatnonzero(link)]
        same = np.unique(group[back:high][link])
        group[np.isin(group, same)] = group[p]
        # covered: no set outside the pivot's ball can be within R
        alive[back:high][link & (distance + R < nearest - EPS)] = False
    return found


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region to a forest of the links of each region."""
    at, sets, names = None, [], []

    def close() -> list[pa.RecordBatch]:
        if len(names) < 2:
            return []
        links = np.array(join_region(sets, names), np.int64).reshape(-1, 2)
        return [pa.RecordBatch.from_arrays([pa.array(x) for x in local_roots(links[:, 0], links[:, 1])], names=["a", "b"])]

    for batch in batches:
        for rep, region, elements in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            if region.as_py() != at:
                yield from close()
                at, sets, names = region.as_py(), [], []
            sets.append(np.frombuffer(elements.as_py(), U64))
            names.append(rep.as_py())
    yield from close()
    release()


def leaf_links(members: DataFrame) -> DataFrame:
    """(a, b): links within regions of bounded size."""
    return members.repartition("region").sortWithinPartitions("region").select("rep", "region", "elements").mapInArrow(_leaves, "a long, b long")


def _distances(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Distances of the sets of a region (a share of them) to its pivots, and the places of those within R."""
    if not len(left) or not len(right):
        return pd.DataFrame({"rep": [], "region": [], "n": [], "d": [], "hits": []}).astype({"rep": "int64", "region": "int64", "n": "int64", "d": object, "hits": object})
    pivots = [np.frombuffer(x, U64) for x in right.sort_values("place")["elements"]]
    out_d, out_l = [], []
    for elements in left["elements"]:
        s = np.frombuffer(elements, U64)
        inter = np.array([(p[np.minimum(np.searchsorted(p, s), len(p) - 1)] == s).sum() for p in pivots])
        size = np.array([len(p) for p in pivots])
        out_d.append((1 - inter / (len(s) + size - inter)).tolist())
        out_l.append(np.flatnonzero(linked(inter, len(s), size)).tolist())
    return pd.DataFrame({"rep": left["rep"], "region": left["region"], "n": left["n"], "d": out_d, "hits": out_l})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, sets of places that one set is linked to) to (region, group of each place)."""
    for batch in batches:
        out = []
        for every in batch.column(1).to_pylist():
            group = list(range(PIVOTS))
            for places in every:
                same = {group[p] for p in places}
                group = [min(same) if g in same else g for g in group]
            out.append(group)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["region", "group"])


def split_regions(members: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split the regions of ``members``, all of them large: (members of cells, members of regions that do not shrink, links to pivots)."""
    picked = [F.min_by("rep", F.xxhash64("rep", F.lit(100 * level + j))).alias(f"p{j}") for j in range(PIVOTS)]
    chosen = members.groupBy("region").agg(*picked, F.sum("n").alias("total"))
    chosen = chosen.select("region", "total", F.posexplode(F.array_distinct(F.array(*(f"p{j}" for j in range(PIVOTS))))).alias("place", "rep"))
    pivots = written(members.join(small(written(chosen, "chosen"), SMALL), ["region", "rep"]).select("region", "rep", "elements", "place", "total"), "pivots")
    salts = F.greatest(F.lit(1), F.ceil(F.col("total") / SHARE)).cast("int")
    shares = pivots.groupBy("region").agg(F.first("total").alias("total"))
    left = members.join(small(shares, SMALL), "region").withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int"))
    right = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    found = left.groupBy("region", "salt").cogroup(right.groupBy("region", "salt")).applyInPandas(_distances, "rep long, region long, n long, d array<double>, hits array<int>")
    found = written(found, "distances")
    hit = found.select(F.col("rep").alias("a"), "region", F.explode("hits").alias("place"))
    names = pivots.select("region", "place", F.col("rep").alias("b"))
    links = written(hit.join(small(names, SMALL), ["region", "place"]).select("a", "b"), "pivot-links")
    groups = found.where(F.size("hits") > 0).groupBy("region").agg(F.collect_set("hits").alias("every"))
    groups = written(groups.mapInArrow(_groups, "region long, group array<int>"), "pivot-groups")
    # -1: linked to no pivot
    found = found.join(small(groups, SMALL), "region", "left").withColumn("group", F.when(F.size("hits") > 0, F.get("group", F.get("hits", F.lit(0)))).otherwise(F.lit(-1)))
    at = found.select("rep", "region", F.posexplode("d").alias("j", "d"))
    # d > R is not quite "not linked": on the border the integers decide, so leave some room
    outside = at.where(F.col("d") > R - EPS).groupBy("region", "j").agg(F.min(F.when(F.col("d") > R + EPS, F.col("d")).otherwise(F.lit(0.0))).alias("nearest"))
    covered = at.join(small(written(outside, "outside"), SMALL), ["region", "j"], "left").where((F.col("d") < R - EPS) & (F.col("d") + R < F.coalesce("nearest", F.lit(9.0)) - EPS)).select("region", "rep").distinct()
    stays = found.join(covered, ["region", "rep"], "left_anti")
    least = F.array_min("d")
    home = F.when(least <= NEAR, F.array_position("d", least).cast("int") - 1).otherwise(F.lit(-1))
    window = F.filter(F.transform("d", lambda d, j: F.struct(d.alias("d"), j.alias("j"))), lambda x: (x["j"] != F.col("home")) & (x["d"] <= F.least(F.col("least") + 2 * R, F.lit(NEAR + R)) + EPS))
    cells = stays.withColumn("least", least).withColumn("home", home).select("region", "rep", "n", "group", F.explode(F.concat(F.array("home"), F.transform(window, lambda x: x["j"]))).alias("cell"))
    cells = written(cells, "cell-members")
    part = cells.groupBy("region", "cell", "group").agg(F.sum("n").alias("of_group"), F.count(F.lit(1)).alias("sets"))
    cell = part.groupBy("region", "cell").agg(F.sum("of_group").alias("all"), F.sum("sets").alias("sets"), F.max(F.when(F.col("group") >= 0, F.struct("of_group", "group"))).alias("largest"))
    others = F.col("all") - F.coalesce("largest.of_group", F.lit(0))
    live = cell.where((F.col("sets") > 1) & (others > 0))
    # shares of the largest group beside all of the others, where these are few
    cuts = F.when((others <= LEAF // 2) & (F.col("all") > LEAF), F.ceil(F.col("largest.of_group") / (LEAF // 2)).cast("int")).otherwise(F.lit(1))
    live = written(live.select("region", "cell", "all", others.alias("others"), cuts.alias("cuts"), F.col("largest.group").alias("main")), "cells-left")
    # a region whose cells hold much more than it does is left as it was
    after = live.groupBy("region").agg(F.sum(F.col("all") + (F.col("cuts") - 1) * F.col("others")).alias("after"))
    stuck = small(written(after.join(shares, "region").where(F.col("after") > GAIN * F.col("total")).select("region"), "stuck"), SMALL)
    hard = written(members.join(stuck, "region", "left_semi").select(*members.columns), "hard")
    live = small(written(live.join(stuck, "region", "left_anti").select("region", "cell", "cuts", "main"), "cells-next"), SMALL)
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    share = F.when(F.coalesce(F.col("group") == F.col("main"), F.lit(False)), F.array(F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))).otherwise(every)
    placed = cells.join(live, ["region", "cell"]).select("region", "rep", "cell", F.explode(share).alias("share"))
    placed = written(placed, "placed")
    new = members.join(small(placed, SMALL), ["region", "rep"]).select("rep", F.xxhash64("region", "cell", "share", F.lit(level)).alias("region"), "n", "elements")
    return written(new, "cells"), hard, links


def by_size(members: DataFrame) -> DataFrame:
    """The same in windows of size: a set and those up to 1.25 times as large share a region."""
    slot = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("long")
    cells = F.explode(F.array(slot, slot - 1)).alias("cell")
    return members.select("rep", "n", "elements", "region", cells).select("rep", F.xxhash64("region", "cell", F.lit(-1)).alias("region"), "n", "elements")


def in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every pair of blocks of a region as a region of its own; exact for regions that do not shrink."""
    blocks = F.greatest(F.lit(2), F.ceil(F.col("total") / (BLOCK // 2))).cast("int")
    rows = members.join(sizes.select("region", blocks.alias("blocks")), "region").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("mine")))
    rows = rows.select("rep", "n", "elements", "region", "mine", other.alias("other"))
    return rows.select("rep", F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other"), F.lit(-2)).alias("region"), "n", "elements")


def region_links(members: DataFrame) -> DataFrame:
    """(a, b): links that connect the components of every region."""
    links = None

    def add(more: DataFrame) -> None:
        nonlocal links
        links = more if links is None else links.union(more)

    def leaves(members: DataFrame, most: int) -> tuple[DataFrame, DataFrame] | None:
        """Join the regions of up to ``most`` elements; members and sizes of the others, None if there are none."""
        sizes = members.groupBy("region").agg(F.sum("n").alias("total"))
        large = written(sizes.where(F.col("total") > most), "large")
        if not large.take(1):
            add(written(leaf_links(members), "links"))
            return None
        names = small(large.select("region"), SMALL)
        add(written(leaf_links(members.join(names, "region", "left_anti")), "links"))
        return written(members.join(names, "region", "left_semi").select("rep", "region", "n", "elements"), "large-members"), large

    hard: DataFrame | None = None
    for level in range(LEVELS + 1):
        left = leaves(members, LEAF)
        if left is None:
            break
        members, stuck = (members.where("false"), left[0]) if level == LEVELS else (None, None)
        if stuck is None:
            members, stuck, more = split_regions(left[0], level)
            add(more)
        hard = stuck if hard is None else hard.union(stuck)
    if hard is not None and hard.take(1):
        left = leaves(hard, BLOCK)
        left = left and leaves(written(by_size(left[0]), "size-windows"), BLOCK)
        if left:
            add(written(leaf_links(in_blocks(*left)), "links"))
    return links


def jaccard_rows(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, mark, row, n, component_id, first) of each row; ``mark``: xxhash64 of its text; ``first``: it stands for its component."""
    pairs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    # a bucket for some thousand documents, and a task for some eight buckets, at any size
    buckets = 1 << max(6, min(20, (max(1, docs.count()) // 1000).bit_length()))
    schema = ", ".join(f"{x} {'binary' if t == pa.binary() else 'long'}" for x, t in DOCS)
    both = pairs.mapInArrow(_first(buckets, k), schema).repartition(buckets // 8, "bucket").sortWithinPartitions("bucket").mapInArrow(_second, GROUPS)
    both = written(both, "groups")
    rows = both.where("kind = 0").select("doc_id", "mark", "row", "n", "fa", "fb")
    keep: list[DataFrame] = []
    with passing(keep):
        regions = components(candidate_edges(both))
        best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "mark")).alias("rep")
        sets = written(rows.where("n > 0").groupBy("n", "fa", "fb").agg(best), "sets")
        known = sets.join(regions, sets["fa"] == regions["node"]).select(F.col("rep.doc_id").alias("id"), F.col("rep.mark").alias("of"), F.col("root").alias("region"), "fa", "fb")
        known = written(known, "region-members")
        texts = pairs.join(small(known, SMALL), pairs["doc_id"].eqNullSafe(known["id"]) & (pairs["mark"] == known["of"])).select("region", "fa", "fb", "text")
        members = texts.mapInArrow(_sets(k), "rep long, region long, n long, elements binary")
        if known.where("id is null").take(1):
            members = members.dropDuplicates(["rep"])
        links = components(region_links(written(members, "members")))
        rooted = sets.join(links, sets["fa"] == links["node"], "left").select("n", "fa", "fb", "rep", F.coalesce("root", "fa").alias("root"))
        rooted = written(rooted, "rooted")
        heads = rooted.groupBy("root").agg(F.min("rep").alias("head"))
        keep.append(written(rooted.join(heads, "root").select("n", "fa", "fb", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("head")), "named"))
    named = keep[0]
    some = rows.where("n > 0").join(named, ["n", "fa", "fb"])
    alone = rows.where("n = 0").select("doc_id", "mark", "row", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return some.select("doc_id", "mark", "row", "n", "component_id", (F.col("row") == F.col("head")).alias("first")).union(alone)


def jaccard_components(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    return jaccard_rows(docs, k).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
