"""N-gram Jaccard self-join by universe partition and pigeonhole, exact, up to connected components.

1. Shingles: one pass gives each text's set size, a 128-bit identity of its set, and how many segments of each
   scheme it fills (marginalia.llm.partition_signatures). Texts with equal sets form a class with one
   representative; only classes go on.
2. Segment signatures are dealt into buckets by hash as packed arrays. A signature that more than `frequent`
   classes share is too dear to be a place of encounter: it is given no units. Every other one makes its classes meet.
   Of a pair the number of equal segments is counted, and it goes on only if that can suffice for its sizes.
3. A class whose other filled segments number more than its allowed differences is done. The rest, short of
   units, sign again with one-deletion neighbourhoods, where a segment is worth two units, among themselves.
4. What is still short consists nearly all of frequent content (large groups of near copies). These classes
   are grouped into families by their common signatures; each family's best-filled member is verified
   against all of it, and members that did not link to it are compared in blocks with those of other
   components, as products of incidence matrices.
5. Candidates are verified on whole sets; links become components.

Nothing is capped: a frequent signature only changes the way in which its pairs are found. Null and empty texts
have an empty set and are linked with nothing. Texts with fewer words than a shingle have one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import partition_signatures as ps
from marginalia.llm.components import components
from marginalia.llm.partition_signatures import Similarity
from marginalia.llm.word_hashes import parts
from marginalia.workspace import written

#: Classes that may meet by one signature.
FREQUENT = 32
#: Signatures that a task packs before it hands them on, and that a bucket should hold.
PACKED, BUCKET = 1 << 18, 1 << 20
#: Ids up to which a set of documents is picked by a broadcast; beyond, by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Classes of one block of a family.
BLOCK = 1000

_SETS = "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<int>, filled array<int>, needed array<int>"


def shingle_classes(docs: DataFrame, sim: Similarity) -> DataFrame:
    """docs: doc_id, text. Per document its set's size and identity, and by scheme the filled and the needed segments."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, 1):
                rows: list[tuple] = []
                for s in ps.shingle_sets(texts, sim):
                    found = ps.schemes(len(s), sim)
                    filled = [ps.filled_segments(s, band, sim) for band, _ in found]
                    rows.append((len(s), *ps.identity(s), [band for band, _ in found], filled, [h + 1 for _, h in found]))
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 3
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "k1", "k2", "bands", "filled", "needed"])

    return docs.mapInArrow(measure, _SETS)


_PACKED = "bucket int, sigs binary, ids binary, bands binary, marks binary, hot binary"
_MET = "kind tinyint, a bigint, b bigint, band int, n bigint"


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(x)))


def _distinct(sigs: np.ndarray, ids: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, sigs))
    sigs, ids, bands = sigs[order], ids[order], bands[order]
    new = np.ones(len(sigs), bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (ids[1:] != ids[:-1])
    return sigs[new], ids[new], bands[new]


def _counted(ids: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """(id, band, count) rows."""
    pairs, n = np.unique(np.stack([ids, bands.astype(np.int64)], axis=1), axis=0, return_counts=True)
    return np.column_stack([pairs, n]).astype(np.int64)


def packed_signatures(docs: DataFrame, sim: Similarity, buckets: int, neighbours: bool) -> DataFrame:
    """Signatures of the documents' sets, packed by bucket. Copies within a task sign once. A signature that is frequent
    within a pack is handed on as a mark, its members as counts, so that no bucket gathers a common passage's rows."""

    most = min(1 << 20, max(PACKED, 64 * buckets))

    def pack(sigs: np.ndarray, ids: np.ndarray, bands: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket that holds something; the work is in the signatures, however many buckets there are."""
        sigs, ids, bands = _distinct(sigs, ids, bands)
        starts, sizes = _runs(sigs)
        common = np.repeat(sizes > FREQUENT, sizes)
        marks = sigs[starts[sizes > FREQUENT]]
        hot = _counted(ids[common], bands[common])
        sigs, ids, bands = sigs[~common], ids[~common], bands[~common]
        at = [(x % np.uint64(buckets)).astype(np.int64) for x in (sigs, marks, hot[:, 0].view(np.uint64))]
        which = np.unique(np.concatenate(at))
        order = [np.argsort(x, kind="stable") for x in at]
        edges = [np.append(np.searchsorted(x[o], which), len(x)) for x, o in zip(at, order, strict=True)]

        def laid(values: np.ndarray, k: int) -> pa.Array:
            size = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
            return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer((edges[k] * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values[order[k]]))])

        columns = [pa.array(which.astype(np.int32)), laid(sigs, 0), laid(ids, 0), laid(bands, 0), laid(marks, 1), laid(hot, 2)]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "sigs", "ids", "bands", "marks", "hot"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0
        seen: set[tuple[int, int]] = set()

        def flush() -> pa.RecordBatch:
            counts = [len(x) for x, _, _ in held]
            ids, bands = np.repeat(np.array([i for _, i, _ in held], np.int64), counts), np.repeat(np.array([b for _, _, b in held], np.int16), counts)
            return pack(np.concatenate([x for x, _, _ in held]), ids, bands)

        for batch in batches:
            for _, texts in parts(batch, 0):
                for s in ps.shingle_sets(texts, sim):
                    key = ps.identity(s)
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    for band, _ in ps.schemes(len(s), sim):
                        x = ps.sign(s, band, sim, neighbours)
                        held.append((np.concatenate([x.exact, x.without_one]) if neighbours else x.exact, key[0], band))
                        size += len(held[-1][0])
                if len(seen) > 50_000:
                    seen.clear()
                if size > most:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(sign, _PACKED)


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket: kind 0, classes a < b that share n signatures of a band; kind 1, class a has n frequent signatures in a band."""
    read = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)])
    sigs, ids, bands = _distinct(read("sigs", np.uint64), read("ids", np.int64), read("bands", np.int16))
    marks = np.unique(read("marks", np.uint64))
    hot = [read("hot", np.int64).reshape(-1, 3)]
    starts, sizes = _runs(sigs)
    marked = np.isin(sigs[starts], marks) if len(starts) else np.zeros(0, bool)
    common = (sizes > FREQUENT) | marked
    members = np.repeat(common, sizes)
    if members.any():
        hot.append(_counted(ids[members], bands[members]))
    met = [np.zeros((0, 3), np.int64)]
    for n in np.unique(sizes[~common & (sizes > 1)]).tolist():
        first = starts[~common & (sizes == n)]
        groups = ids[first[:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        met.append(np.column_stack([groups[:, i].ravel(), groups[:, j].ravel(), np.repeat(bands[first].astype(np.int64), len(i))]))
    pairs = np.concatenate(met)
    pairs, n = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
    hots = np.concatenate(hot)
    kinds = np.concatenate([np.zeros(len(pairs), np.int8), np.ones(len(hots), np.int8)])
    a, b = np.concatenate([pairs[:, 0], hots[:, 0]]), np.concatenate([pairs[:, 1], np.zeros(len(hots), np.int64)])
    band, count = np.concatenate([pairs[:, 2], hots[:, 1]]).astype(np.int32), np.concatenate([n, hots[:, 2]])
    return pa.table([pa.array(x) for x in (kinds, a, b, band, count)], names=["kind", "a", "b", "band", "n"])


def meetings(docs: DataFrame, sim: Similarity, signatures: int, neighbours: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, band, n) of classes that share n infrequent signatures, and (k1, band, hot) counts of frequent ones."""
    buckets = max(-(-signatures // BUCKET), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = written(packed_signatures(docs, sim, buckets, neighbours).groupBy("bucket").applyInArrow(_meet, _MET), "met")
    pairs = met.where("kind = 0").groupBy("a", "b", "band").agg(F.sum("n").alias("n"))
    hot = met.where("kind = 1").groupBy(F.col("a").alias("k1"), "band").agg(F.sum("n").alias("hot"))
    return pairs, hot


def _small(table: DataFrame) -> DataFrame:
    """A table to join with: broadcast if its checked size allows."""
    table = written(table, "small")
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_IDS else table


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) whose id is in ids (doc_id, distinct)."""
    if ids.count() <= MAX_BROADCAST_IDS:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(ids, "doc_id", "left_semi")


def _set_table(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, n, elements (the set as packed hashes)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, 1):
                sets = ps.shingle_sets(texts, sim)
                columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "elements"])

    return docs.mapInArrow(pack, "doc_id bigint, n bigint, elements binary")


def verified(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """pairs: u, v. Those whose whole sets are similar enough."""
    a, b = (sets.select(F.col("doc_id").alias(c), F.col("elements").alias(f"s{c}")) for c in "uv")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k) for k in (2, 3))
            keep = [ps.linked(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64), sim) for p, q in zip(x, y, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "su", "sv").mapInArrow(check, "u bigint, v bigint")


def _similar_sizes(sim: Similarity, a: str, b: str):
    return sim.q * F.least(a, b) >= sim.p * F.greatest(a, b)


def _allowed(sim: Similarity, a: str, b: str):
    return F.floor((sim.q - sim.p) * (F.col(a) + F.col(b)) / (sim.q + sim.p))


def candidate_pairs(pairs: DataFrame, units: DataFrame, sim: Similarity) -> DataFrame:
    """pairs (a, b, band, n) whose sizes are compatible and whose equal segments suffice on both sides; as representatives u, v.

    units: k1, band, doc_id, n, cheap (filled segments that are not frequent)."""
    side = lambda c: units.select(F.col("k1").alias(c), "band", F.col("doc_id").alias(f"d{c}"), F.col("n").alias(f"n{c}"), F.col("cheap").alias(f"c{c}"))
    both = pairs.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])
    enough = F.col("n") >= F.greatest("ca", "cb") - _allowed(sim, "na", "nb")
    return both.where(_similar_sizes(sim, "na", "nb") & enough).select(F.least("da", "db").alias("u"), F.greatest("da", "db").alias("v")).where("u <> v").distinct()


def _family_links(rest: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """Links within classes that are short of units. rest: doc_id."""
    members = written(_set_table(_picked(docs, rest), sim), "rest-sets")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each signature within a pack: its least member with each other one (kind 0), and itself (kind 1)."""
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sigs = np.concatenate([x for x, _ in held])
            ids = np.repeat(np.array([i for _, i in held], np.int64), [len(x) for x, _ in held])
            order = np.lexsort((ids, sigs))
            sigs, ids = sigs[order], ids[order]
            starts, sizes = _runs(sigs)
            least = ids[starts]
            edges = np.unique(np.column_stack([np.repeat(least, sizes), ids]), axis=0)
            edges = edges[edges[:, 0] != edges[:, 1]]
            kind = np.concatenate([np.zeros(len(edges), np.int8), np.ones(len(starts), np.int8)])
            x = np.concatenate([edges[:, 0], sigs[starts].view(np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(np.concatenate([edges[:, 1], least]))], names=["kind", "x", "y"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = np.frombuffer(raw.as_py(), np.uint64)
                for band, _ in ps.schemes(len(s), sim):
                    held.append((ps.sign(s, band, sim).exact, doc_id))
                    size += len(held[-1][0])
                if size > PACKED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = written(members.select("doc_id", "elements").mapInArrow(stars, "kind tinyint, x bigint, y bigint"), "rest-stars")
    local = found.where("kind = 0").select(F.col("x").alias("u"), F.col("y").alias("v"))
    packs = found.where("kind = 1").select(F.col("x").alias("sig"), F.col("y").alias("v"))
    # At most one row a signature and pack: a signature's rows grow with the packs, not with its members.
    top = packs.groupBy("sig").agg(F.min("v").alias("u"), F.count(F.lit(1)).alias("packs")).where("packs > 1")
    across = packs.join(top, "sig").select("u", "v").where("u <> v").distinct()
    family = _small(components(local.unionByName(across)).select(F.col("node").alias("doc_id"), F.col("component").alias("family")))
    grouped = written(members.join(family, "doc_id"), "families")

    # The member most of whose elements are common in its family, judged on a fixed share of the universe of hashes.
    share = _element_counts(grouped)
    leader = _small(share.groupBy("family").agg(F.max_by("doc_id", F.struct("common", (-F.col("doc_id")).alias("first"))).alias("leader")))
    stars_ = grouped.select("doc_id", "family").join(leader, "family").where("doc_id <> leader").select(F.least("doc_id", "leader").alias("u"), F.greatest("doc_id", "leader").alias("v"))
    near = written(verified(stars_, members, sim), "leader-links")
    label = _small(components(near).select(F.col("node").alias("doc_id"), "component"))
    placed = grouped.join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    led = written(placed.join(leader.select(F.col("leader").alias("doc_id"), F.lit(True).alias("is_leader")), "doc_id", "left"), "placed")
    # One row a family; no family's members have to meet in one task for these joins.
    of_leader = _small(led.where("is_leader").select("family", F.col("component").alias("led_by")))
    marked = led.drop("is_leader").join(of_leader, "family").withColumn("stray", F.col("component") != F.col("led_by"))
    return near.unionByName(_block_links(written(marked, "marked"), sim))


def _element_counts(grouped: DataFrame) -> DataFrame:
    """doc_id, family, common: the mean number of family members that hold an element, over the elements of a fixed sixteenth of the universe (all of small sets)."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for raw in batch.column(2):
                s = np.frombuffer(raw.as_py(), np.uint64)
                part = s[(s & np.uint64(15)) == 0]
                out.append((part if len(part) >= 4 else s[:4]).view(np.int64))
            sizes = [len(x) for x in out]
            ids, families = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), sizes) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(families), pa.array(np.concatenate(out))], names=["doc_id", "family", "element"])

    rows = grouped.select("doc_id", "family", "elements").mapInArrow(sample, "doc_id bigint, family bigint, element bigint")
    counts = rows.groupBy("family", "element").agg(F.count(F.lit(1)).alias("df"))
    return rows.join(counts, ["family", "element"]).groupBy("doc_id", "family").agg(F.avg("df").alias("common"))


def _block_links(marked: DataFrame, sim: Similarity) -> DataFrame:
    """Links between members of different components of a family, one of them a stray: blocks of strays against all blocks."""
    sizes = marked.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.ceil(F.count_if("stray") / BLOCK).alias("stray_blocks")).where("stray_blocks > 0")
    rows = marked.join(_small(sizes), "family")
    at = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("long")
    every = rows.withColumn("block", at("blocks"))
    strays = rows.where("stray").withColumn("stray_block", at("stray_blocks"))
    # A block of all meets each block of strays, a block of strays each block of all.
    left = every.select("family", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stray_blocks") - 1)).alias("stray_block"), F.lit(0).alias("side"), "doc_id", "component", "elements")
    right = strays.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "stray_block", F.lit(1).alias("side"), "doc_id", "component", "elements")

    def compare(table: pa.Table) -> pa.Table:
        return _compare_block(table, sim)

    return left.unionByName(right).groupBy("family", "block", "stray_block").applyInArrow(compare, "u bigint, v bigint")


def _compare_block(table: pa.Table, sim: Similarity) -> pa.Table:
    """A spanning forest of the links between the two sides."""
    side = table.column("side").to_numpy()
    ids, component = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("elements")]
    rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    empty = np.zeros(0, np.int64)
    if not len(rows) or not len(cols):
        return pa.table({"u": pa.array(empty), "v": pa.array(empty)})
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, elements = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    known = np.intersect1d(np.concatenate([sets[k] for k in rows]), np.concatenate([sets[k] for k in cols]))
    column = np.minimum(np.searchsorted(known, elements), max(len(known) - 1, 0))
    hit = known[column] == elements if len(known) else np.zeros(len(elements), bool)
    owner, column = owner[hit], column[hit]
    common = np.zeros((len(rows), len(cols)), np.float32)
    place = np.empty(len(sets), np.int64)
    place[rows], place[cols] = np.arange(len(rows)), np.arange(len(cols))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = 2048
    for a in range(0, len(known), step):
        lo, hi = np.searchsorted(column, [a, a + step])
        o, c = owner[lo:hi], column[lo:hi] - a
        x, y = np.zeros((len(rows), step), np.float32), np.zeros((len(cols), step), np.float32)
        first = side[o] == 0
        x[place[o[first]], c[first]] = 1
        y[place[o[~first]], c[~first]] = 1
        common += x @ y.T
    union = sizes[rows][:, None] + sizes[cols][None, :] - common
    good = (sim.q * common >= sim.p * union) & (component[rows][:, None] != component[cols][None, :])
    parent = {int(c): int(c) for c in np.unique(component)}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []
    for i, j in np.argwhere(good):
        a, b = find(int(component[rows[i]])), find(int(component[cols[j]]))
        if a != b:
            parent[a] = b
            out.append((int(ids[rows[i]]), int(ids[cols[j]])))
    u, v = zip(*out, strict=True) if out else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sim: Similarity = Similarity()) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the least id reachable by links."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(shingle_classes(docs, sim), "sets")
    per_class = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("bands", "filled", "needed")))
    classes = written(per_class, "classes")
    schemes = classes.select("k1", "doc_id", "n", F.explode(F.arrays_zip("bands", "filled", "needed")).alias("s")).select("k1", "doc_id", "n", F.col("s.bands").alias("band"), "s.filled", "s.needed")
    total = schemes.agg(F.sum("filled").alias("n")).first()["n"] or 0
    none = sets.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v")).where(F.lit(False))
    links = none
    if total:
        pairs, hot = meetings(docs, sim, total, neighbours=False)
        units = written(schemes.join(hot, ["k1", "band"], "left").withColumn("cheap", F.col("filled") - F.coalesce("hot", F.lit(0))), "units")
        candidates = [candidate_pairs(pairs, units, sim)]
        short = written(units.where("cheap < needed").select("doc_id", "n").distinct(), "short")
        short_n = short.agg(F.sum("n").alias("n")).first()["n"] or 0
        rest = None
        if short_n:
            few = _picked(docs, short.select("doc_id"))
            near, near_hot = meetings(few, sim, 3 * short_n, neighbours=True)
            worth = _neighbour_units(few, sim)
            left = worth.join(near_hot, ["k1", "band"], "left").where(F.col("units") - 2 * F.coalesce("hot", F.lit(0)) < F.col("needed"))
            rest = written(left.select("doc_id").distinct(), "rest")
            near_units = units.select("k1", "band", "doc_id", "n", F.lit(0).alias("cheap"))
            candidates.append(candidate_pairs(near, near_units, sim))
        wanted = candidates[0] if len(candidates) == 1 else candidates[0].unionByName(candidates[1]).distinct()
        wanted = written(wanted, "candidates")
        ids = wanted.select(F.col("u").alias("doc_id")).unionByName(wanted.select(F.col("v").alias("doc_id"))).distinct()
        known = written(_set_table(_picked(docs, written(ids, "candidate-ids")), sim), "candidate-sets")
        links = verified(wanted, known, sim)
        if rest is not None and not rest.isEmpty():
            links = links.unionByName(_family_links(rest, docs, sim))
    found = components(links)
    labelled = classes.select("k1", "k2", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    labels = written(labelled.select("k1", "k2", F.coalesce("component", "doc_id").alias("component_id")), "labels")
    joined = sets.select("doc_id", "n", "k1", "k2").join(labels, ["k1", "k2"], "left")
    return joined.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _neighbour_units(docs: DataFrame, sim: Similarity) -> DataFrame:
    """doc_id, k1, band, units with one-deletion neighbourhoods, needed."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch, 1):
                rows = []
                for doc_id, s in zip(part.column(0).to_pylist(), ps.shingle_sets(texts, sim), strict=True):
                    k1 = ps.identity(s)[0]
                    rows += [(doc_id, k1, band, ps.sign(s, band, sim, neighbours=True).units, h + 1) for band, h in ps.schemes(len(s), sim)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                columns = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "k1", "band", "units", "needed"])

    return docs.mapInArrow(measure, "doc_id bigint, k1 bigint, band int, units bigint, needed bigint")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sim: Similarity = Similarity()) -> DataFrame:
    """The rows of docs without those whose component has a lesser id, with all their columns. Rows of one id are one document and stay together."""
    found = ngram_components(docs, id_col, text_col, sim)
    gone = written(found.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("gone_id")).distinct(), "copies")
    if gone.count() <= MAX_BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")
