"""N-gram Jaccard join: T-occurrence search over inverted lists, as DivideSkip does it.

A document's set are its distinct 5-word shingles, hashed. A pair with Jaccard similarity of at least t shares at least
T = ceil(t * n) of the n shingles of either. Of a document's n inverted lists, the T - 1 longest are set apart; any partner
then occurs in at least one of the remaining short lists. So only the short lists are merged, and partners that the merge leaves are
probed for the long ones. A long list is never built: whether a candidate stands on it is the question whether its shingle is in
the candidate's sorted set, and is answered there by binary search.

1. Summaries. One pass gives for each document the signature of its set (equal sets are one node from here on), its size and a
   parity bitmap, and counts all documents into LENGTHS hash buckets, a table of fixed size that is broadcast. Lists are ordered by
   the half octave of the bucket's count, then by hash. The order is the same for all, so the result doesn't depend on it; it only
   decides which lists are short.
2. A second pass sends each node to its n - T + 1 shortest lists. One sort brings each list's nodes together; lists of one node
   are done. Lists that may be longer than LIST_ROWS by these counts are split, and their parts' pivots meet in a second step. Each part has PIVOTS
   pivots, its first nodes by as many orders. Pairs of a node and a pivot that meet on as many lists as linked sets of one size share are
   compared by bitmap (the number of differing bits is at most the size of the symmetric difference); the closest pairs of each node are verified
   exactly. Links give components. This step only saves work in the next one, which misses nothing that it leaves out.
3. Lists whose members are all in one component are done. In the others, each member looks for partners in other, larger
   components (ties by component): its lists are merged by one sort that counts how often each partner occurs, partners with too few
   common short lists to reach T are dropped, the rest is compared by bitmap and verified exactly; first the likeliest of each member, then, with
   the components that this leaves, all. After that each pair of different components has been compared wherever
   a link was possible, and no group was ever expanded into all its pairs.

Defined results: a null or empty text, or one of separators only, has no shingles and is linked with nothing; a text of one to
four words has one shingle, the whole sequence. Copies share a component. Rows with a null key are kept, with no component, and link
nothing. A repeated key keeps a row for each of its rows; their sets count for the one key. Only the key and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import doc_words, mix, shingle_hashes, short_hash, slices, table, whole_runs, written
from folioscope.llm.graph import components

LENGTHS_BITS = 18
#: Pivots of each list, and how many of each node's closest pivots are verified before all other pairs are looked at. Both only move work
#: from the last step to the first.
PIVOTS, CLOSEST = 6, 8
#: Rows of one list that go to one task.
LIST_ROWS = 1_000_000
#: Members of one list that go together when a list's partners are looked up; longer lists go in several parts.
PART = 1024
#: Orders of the nodes that give the pivots: each takes the node with the smallest `node ^ order`.
ORDERS = mix(np.arange(1, 65, dtype=np.uint64)).view(np.int64)


def shingle_sets(b: pa.RecordBatch, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The rows' sorted distinct shingle hashes, one row after the other, and where each row begins and the last ends."""
    _, _, _, words, first = doc_words(b, text="t")
    hashed, n = shingle_hashes(words, k), np.diff(first)
    ends = np.cumsum(np.where(n >= k, n - k + 1, np.minimum(n, 1)))
    begins = np.append(0, ends)
    out = np.empty(int(begins[-1]), np.uint64)
    for s, w, at in zip(first[:-1].tolist(), n.tolist(), begins.tolist(), strict=False):
        if w >= k:
            own = out[at : at + w - k + 1]
            own[:] = hashed[s : s + w - k + 1]
            own.sort()
        elif w:
            out[at] = short_hash(words[s : s + w])
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[begins[begins < len(out)]] = True
    return out[fresh], np.append(0, np.cumsum(fresh))[begins]


def pieces(values: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    return [values[s:e] for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


def parity_bitmap(s: np.ndarray) -> bytes:
    bits = max(64, 1 << int(2 * len(s)).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of sets of n and m that has Jaccard similarity of at least percent / 100."""
    return -(-(percent * (n + m)) // (100 + percent))


def summaries(docs: DataFrame, k: int = 5) -> DataFrame:
    """Rows (doc, node, n, bits) of all documents, and rows (bucket, count) of each task: how many of its documents have a
    shingle in each of 2^LENGTHS_BITS buckets."""
    size, shift = 1 << LENGTHS_BITS, np.uint64(64 - LENGTHS_BITS)
    none = {"doc": pa.int64(), "node": pa.int64(), "n": pa.int32(), "bits": pa.binary(), "bucket": pa.int32(), "count": pa.int64()}

    def batch(rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: columns[c] if c in columns else pa.nulls(rows, t) for c, t in none.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in slices(batches, "t"):
            values, begins = shingle_sets(b, k)
            sets = pieces(values, begins)
            total += np.bincount((values >> shift).astype(np.int64), minlength=size)
            yield batch(b.num_rows, doc=b.column("doc"), node=pa.array([signature(s) for s in sets], pa.int64()), n=pa.array(np.diff(begins), pa.int32()), bits=pa.array([parity_bitmap(s) for s in sets], pa.binary()))
        at = np.flatnonzero(total)
        yield batch(len(at), bucket=pa.array(at, pa.int32()), count=pa.array(total[at]))

    return docs.mapInArrow(run, "doc long, node long, n int, bits binary, bucket int, count long")


def signature(s: np.ndarray) -> int:
    return int(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), np.int64)[0])


def short_lists(docs: DataFrame, lengths: np.ndarray, percent: int, k: int = 5) -> DataFrame:
    """(run, part, node, n): each document's node in its shortest lists; part is -1 where the list isn't split. A list's number is its place in the
    order: the half octave of its bucket's count, then the hash; a part's run is that number under a mask of its own."""
    octave = np.minimum(63, 2 * np.log2(1.0 + lengths)).astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((octave, lengths // LIST_ROWS + 1))  # 2^LENGTHS_BITS numbers each
    shift = np.uint64(64 - LENGTHS_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octave, parts = shared.value
        for b in slices(batches, "t"):
            values, begins = shingle_sets(b, k)
            n = np.diff(begins)
            short = np.where(n > 0, n - -(-(percent * n) // 100) + 1, 0)
            node = np.repeat(np.array([signature(s) for s in pieces(values, begins)], np.int64), short)
            lists = octave[(values >> shift).astype(np.int64)] << np.uint64(58) | values >> np.uint64(6)
            chosen = []
            for own, w in zip(pieces(lists, begins), short.tolist(), strict=True):
                own.sort()
                chosen.append(own[:w])
            lists = np.concatenate(chosen)
            split = parts[((lists << np.uint64(6)) >> shift).astype(np.int64)]
            part = np.where(split > 1, (node.view(np.uint64) % split.astype(np.uint64)).astype(np.int64), -1)
            yield pa.RecordBatch.from_pydict({"run": pa.array(lists.view(np.int64) ^ mask_of(part)), "part": pa.array(part, pa.int32()), "node": pa.array(node), "n": pa.array(np.repeat(n, short), pa.int32())})

    return docs.mapInArrow(run, "run long, part int, node long, n int")


def mask_of(part: np.ndarray) -> np.ndarray:
    return np.where(part < 0, 0, mix(part.astype(np.uint64)).view(np.int64))


def shared_lists(lists: DataFrame) -> DataFrame:
    """(list, part, node, n, pivots) of lists, distinct, without lists of one node."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "run"):
            which, part, node, n = (t[c].to_numpy() for c in ("run", "part", "node", "n"))
            first = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
            several = (np.minimum.reduceat(node, first) != np.maximum.reduceat(node, first)) | (part[first] >= 0)
            rows = np.flatnonzero(np.repeat(several, np.diff(np.append(first, len(node)))))
            if not len(rows):
                continue
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))[rows]
            order = np.lexsort((node[rows], run))
            rows, run = rows[order], run[order]
            fresh = np.append(True, (run[1:] != run[:-1]) | (node[rows[1:]] != node[rows[:-1]]))
            rows, run = rows[fresh], run[fresh]
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            pivots = np.stack([np.minimum.reduceat(node[rows] ^ o, first) ^ o for o in ORDERS[:PIVOTS]], 1)
            pivots = np.repeat(pivots, np.diff(np.append(first, len(rows))), 0)
            yield pa.RecordBatch.from_pydict({
                "list": pa.array(which[rows] ^ mask_of(part[rows])), "part": pa.array(part[rows]), "node": pa.array(node[rows]), "n": pa.array(n[rows]),
                "pivots": pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * PIVOTS, pivots.ravel()),
            })

    return lists.repartition("run").sortWithinPartitions("run").mapInArrow(find, "list long, part int, node long, n int, pivots array<long>")


def differing_bits(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Differing bits of pairs of parity bitmaps, the longer one folded."""
    out = np.zeros(len(x), np.int64)
    (raw_x, off_x), (raw_y, off_y) = ((np.frombuffer(c.buffers()[2], np.uint8), np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)) for c in (x, y))
    size = np.stack([np.diff(off_x), np.diff(off_y)], 1)
    for kx, ky in np.unique(size, axis=0).tolist():
        rows = np.flatnonzero((size == (kx, ky)).all(1))
        for at in np.array_split(rows, -(-len(rows) * max(kx, ky) // (1 << 22))):  # 4 MB at a time
            p, q = raw_x[off_x[at][:, None] + np.arange(kx)], raw_y[off_y[at][:, None] + np.arange(ky)]
            p, q = (z if z.shape[1] == min(kx, ky) else np.bitwise_xor.reduce(z.reshape(len(at), -1, min(kx, ky)), axis=1) for z in (p, q))
            out[at] = np.bitwise_count(p ^ q).sum(1)
    return out


def may_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, far): those of pairs (a, b) whose sizes and bitmaps allow a link, and how many bits differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("na").to_numpy().astype(np.int64), b.column("nb").to_numpy().astype(np.int64)
            far = differing_bits(b.column("ba"), b.column("bb"))
            keep = pa.array(far <= n + m - 2 * least_overlap(n, m, percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(far, pa.int32())], ["a", "b", "far"]).filter(keep)

    wide = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
    return wide.where(f"least(na, nb) * 100L >= greatest(na, nb) * {percent}L").mapInArrow(run, "a long, b long, far int")


def linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, k: int = 5) -> DataFrame:
    """Those of pairs (a, b) of nodes that are linked: each shingle of the smaller set is probed for in the larger one."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            found = pieces(*shingle_sets(b, k))  # of a repeated key only the text whose set is the node's
            own = pa.array([signature(s) == node for s, node in zip(found, b.column("node").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "set": pa.array([s.tobytes() for s in found], pa.binary())}).filter(own)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = nodes.select("node", "doc").join(pairs.selectExpr("explode(array(a, b)) as node").distinct(), "node")
    whole = docs.join(needed, "doc").select("node", "t").mapInArrow(sets, "node long, set binary").dropDuplicates(["node"])
    return pairs.select("a", "b").join(whole.toDF("a", "sa"), "a").join(whole.toDF("b", "sb"), "b").mapInArrow(probe, "a long, b long")


def partners(members: DataFrame, percent: int, best: int | None = None) -> DataFrame:
    """(a, b): for members (list, node, n, component, size) the pairs across components that share enough short lists; with `best`
    only those of each a that share most."""
    rank = F.struct("size", "component")
    open_lists = members.groupBy("list").agg(F.min(rank).alias("low"), F.max(rank).alias("high"), F.count("*").alias("n_members")).where("low.component != high.component or low.size != high.size")
    inside = members.join(open_lists.select("list", "high", "n_members"), "list")
    parts = (
        inside.withColumn("part", F.pmod(F.col("node"), F.ceil(F.col("n_members") / PART)))
        .groupBy("list", "part")
        .agg(F.collect_list(F.struct("node", "n", "size", "component")).alias("m"))
        .select("list", F.col("m.node").alias("docs"), F.col("m.n").alias("ns"), F.col("m.size").alias("sizes"), F.col("m.component").alias("components"))
    )
    queries = inside.where(rank < F.col("high")).select("list", "node", "n", "size", "component")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            row = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(b.column("docs")).to_numpy())
            own, size, comp = (b.column(c).to_numpy()[row] for c in ("n", "size", "component"))
            docs, m, sizes, comps = (b.column(c).flatten().to_numpy() for c in ("docs", "ns", "sizes", "components"))
            larger = (sizes > size) | (sizes == size) & (comps > comp)
            keep = larger & (np.minimum(m, own).astype(np.int64) * 100 >= np.maximum(m, own).astype(np.int64) * percent)
            count = np.bincount(row[keep], minlength=b.num_rows)
            ends = pa.array(np.append(0, np.cumsum(count)), pa.int32())
            out = {"a": b.column("node"), "n": b.column("n"), "docs": pa.ListArray.from_arrays(ends, docs[keep]), "ns": pa.ListArray.from_arrays(ends, m[keep])}
            yield pa.RecordBatch.from_pydict(out).filter(pa.array(count > 0))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "a"):
            row = np.repeat(np.arange(t.num_rows), pa.compute.list_value_length(t["docs"]).to_numpy())
            a, n = t["a"].to_numpy()[row], t["n"].to_numpy()[row].astype(np.int64)
            b, m = (t[c].combine_chunks().flatten().to_numpy() for c in ("docs", "ns"))
            order = np.lexsort((b, a))
            first = np.flatnonzero(np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
            common = np.diff(np.append(first, len(order)))
            a, n, b, m = (x[order[first]] for x in (a, n, b, m.astype(np.int64)))
            longest = np.maximum(-(-(percent * n) // 100), -(-(percent * m) // 100)) - 1
            keep = common >= least_overlap(n, m, percent) - longest
            a, b, common = a[keep], b[keep], common[keep]
            if best is not None:
                order = np.lexsort((b, -common, a))
                a, b = a[order], b[order]
                opens = np.append(True, a[1:] != a[:-1])[: len(a)]
                keep = np.arange(len(a)) - np.maximum.accumulate(np.where(opens, np.arange(len(a)), 0)) < best
                a, b = a[keep], b[keep]
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    got = queries.join(parts, "list").mapInArrow(look, "a long, n int, docs array<long>, ns array<int>")
    return got.repartition("a").sortWithinPartitions("a").mapInArrow(merge, "a long, b long")


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with their components and the components' sizes."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return members.select("list", "node", "n").join(labels.join(sizes, "component", "left"), "node").select("list", "node", "n", "component", F.coalesce("size", F.lit(1)).alias("size"))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) of all nodes after links (a, b): components that links join get the smallest one's label."""
    ends = links.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    new = components(ends).toDF("component", "new")
    return written(labels.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels")


def top_by_distance(near: DataFrame) -> DataFrame:
    """The CLOSEST pairs (x, y, far) of each x."""
    return near.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy("far", "y"))).where(F.col("k") <= CLOSEST)


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, k: int = 5) -> DataFrame:
    """One row for each of docs: key, n_shingles, component_id (the smallest key reachable by links)."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t"))
    both = written(summaries(rows, k), "summaries")
    lengths = np.zeros(1 << LENGTHS_BITS, np.int64)
    counted = both.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("n")).toArrow()
    lengths[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    known = both.where("bucket is null").select("doc", "node", "n", "bits")
    some = known.where("n > 0 and doc is not null")
    nodes = written(some.groupBy("node").agg(F.min(F.struct("doc", "n", "bits")).alias("x")).select("node", "x.*"), "nodes")
    labels = nodes.select("node", F.col("node").alias("component"))

    members = written(shared_lists(short_lists(rows.where("doc is not null"), lengths, percent, k)), "members")
    split = members.where("part >= 0")
    tops = F.array(*[F.min(F.expr(f"node ^ {o}L")).bitwiseXOR(F.lit(o)) for o in ORDERS[:PIVOTS].tolist()])
    hot = split.groupBy("list").agg(tops.alias("tops"))
    between = split.select("list", F.explode("pivots").alias("x")).distinct().join(hot, "list").select("x", F.explode("tops").alias("y"))
    within = members.select(F.col("node").alias("x"), "n", F.explode(F.array_distinct("pivots")).alias("y"))
    sorted_pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    often = F.ceil(2 * percent * F.col("n") / (100 + percent)) - F.ceil(percent * F.col("n") / 100) + 1  # common short lists of linked sets of equal size
    counted = within.where("x != y").groupBy(*sorted_pair).agg(F.count("*").alias("common"), F.min("n").alias("n")).where(F.col("common") >= often)
    pairs = counted.select("a", "b").unionByName(between.where("x != y").select(*sorted_pair)).distinct()
    near = written(may_link(pairs, nodes, percent), "near")
    either = near.selectExpr("inline(array(struct(a as x, b as y, far), struct(b as x, a as y, far)))")
    candidates = top_by_distance(either).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    labels = relabelled(labels, written(linked(candidates, rows, nodes, percent, k), "links"))
    for best in (CLOSEST, None):  # the likeliest partners first: their links leave fewer members to look up against all
        more = written(may_link(partners(written(labelled(members, labels), "labelled"), percent, best), nodes, percent), "more")
        if more.take(1):
            labels = relabelled(labels, written(linked(more, rows, nodes, percent, k), "links"))
    # the smallest key of each component
    of_node = nodes.select("node", "doc").join(labels, "node")
    smallest = of_node.groupBy("component").agg(F.min("doc").alias("c"))
    of_set = of_node.select("node", "component").join(smallest, "component").select("node", "c")
    found = known.select("doc", "n", "node").join(of_set, "node", "left")
    return found.select(F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.coalesce("c", "doc")).otherwise(F.col("doc")).alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
