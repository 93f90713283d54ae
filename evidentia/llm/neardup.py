"""Near-duplicate documents by MinHash with tensored banding.

Exact copies of a shingle set are one class. Of each class, two small collections of `pieces` band
pieces (of `rows` minhashes each) are made; a table key is a pair of a piece of the first and a piece of
the second, so pieces^2 tables cost 2 * pieces * rows minhashes. Rows are dealt by the first piece and
matched on the second inside their task; rows of a first piece that very many classes share are dealt by both
pieces, so each table's bucket is still matched whole. Matches whose signatures agree too little are dropped (at a
distance of over four standard errors from the threshold); the others join classes into clusters. Links
are confirmed on the full shingle sets of each cluster, all pairs of it: intersections
come from an inverted index, and pairs already connected are skipped. A large cluster is cut into blocks, each a file
in the shared folder that holds its rows' sets once. The first block is held against every block; members that are
then in the cluster's largest component need no comparison among each other, and only the rest is held against all
blocks. The tasks read the blocks that they compare one after the other, so no task holds an unbounded cluster and
nothing is copied: disk grows with the cluster, only reads and comparisons grow with its blocks times its rest.
Components follow from the confirmed links; no list of pairs is ever made.

A link at the threshold is a candidate with probability 1 - 3e-5 for 85 % (2.5e-5 are missed by the agreement of
signatures, 24 of 40 places, 5e-6 by the tables) and 1 - 1e-4 for 80 %; a missed one is still confirmed if
its classes share a cluster.

Defined results: null or empty text has no shingles and is linked with nothing; a text of fewer words than
a shingle is one shingle; rows that repeat an id are one node; null ids are linked with nothing, their
component_id is null and they are kept; an empty table gives no rows; `deduplicated` passes other columns
through.
"""

from __future__ import annotations

import hashlib
import io
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, file_system, publish, table
from .encoding import slices
from .graphs import components

_K = np.uint64(0x9E3779B97F4A7C15)
#: Blocks of a cluster that one task holds against the others.
UNIT = 4


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per text); words are parted by ASCII white space."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    arr = pa.array(texts, pa.large_string())
    for c in "\t\n\v\f\r":
        arr = pc.replace_substring(arr, c, " ")
    parts = pc.split_pattern(pc.ascii_lower(arr) if lower else arr, " ")
    coded = parts.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    each = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))
    offsets = parts.offsets.to_numpy()
    kept = np.ones(len(codes), bool)
    if "" in names:
        kept = codes != names.index("")
    before = np.concatenate([[0], np.cumsum(kept)])
    return each[codes[kept]], np.diff(before[offsets])


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, shingles per text)."""
    h, counts = word_hashes(texts, True)
    ends = np.cumsum(counts)
    n = len(h)
    g = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        g = g * _K + h[j : n - size + 1 + j] if len(g) else g
    g = mix(g)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(ends - counts, ends)):
        if b - a >= size:
            s = np.unique(g[a : b - size + 1])
        elif b > a:
            s = np.array([b - a], np.uint64)
            for x in h[a:b]:
                s = mix(s * _K + x)
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


@lru_cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(20240229)
    return r.randint(0, 1 << 62, n).astype(np.uint64) * np.uint64(2) + np.uint64(1), r.randint(0, 1 << 62, n).astype(np.uint64)


def minhashes(flat: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """n minhashes of each non-empty set (the flat sets lie one after the other)."""
    mul, add = _permutations(n)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.zeros((len(starts), n), np.uint64)
    for j in range(n if len(starts) else 0):
        out[:, j] = np.minimum.reduceat(flat * mul[j] + add[j], starts)
    return out


def spanning(n: int, links, centre: int, skip: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect 0..n-1 as all links do. links(i) gives the rows linked with i.

    A row is passed over while it is in the component of one row, the anchor: two rows passed over under the same
    anchor are connected already, so no link between components is missed. When another component is twice as large,
    the anchor moves there and the rows passed over under the old one are asked again.
    """
    label = np.arange(n)
    size = np.ones(n, np.int64)
    seen = np.zeros(n, bool) if skip is None else skip.copy()
    out, anchor, passed = [], centre, []
    todo = [*range(n - 1, -1, -1), centre]
    while todo:
        i = todo.pop()
        if seen[i]:
            continue
        if label[i] == label[anchor] and size[label[anchor]] > 1:
            passed.append(i)
            continue
        seen[i] = True
        others = np.unique(label[links(i)])
        others = others[others != label[i]]
        if not len(others):
            continue
        out += [(i, int(other)) for other in others]
        every = np.append(others, label[i])
        big, total = every[size[every].argmax()], size[every].sum()
        joined = np.zeros(n, bool)
        joined[every] = True
        label[joined[label]] = big
        size[big] = total
        if total >= 2 * size[label[anchor]]:
            anchor = i
            todo += passed[::-1]
            passed = []
    return out


def bucket_edges(s: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spanning edges among the rows of one table's bucket that agree in `least` places of their signatures."""
    common = np.array([np.bincount(s[:, c], minlength=256).argmax() for c in range(s.shape[1])], np.uint8)
    return spanning(len(s), lambda i: np.flatnonzero((s == s[i]).sum(1) >= least), int((s == common).sum(1).argmax()))


def _signatures(column, width: int) -> np.ndarray:
    """The rows of a binary column without nulls, each of `width` bytes, as a matrix."""
    parts = []
    for c in column.chunks:
        at = int(np.frombuffer(c.buffers()[1], np.int32)[c.offset])
        parts.append(np.frombuffer(c.buffers()[2], np.uint8, len(c) * width, at).reshape(-1, width))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def signature_edges(ids: np.ndarray, sig: np.ndarray, second: int, pieces: int, rows: int, least: int) -> list[tuple[int, int]]:
    """Spanning edges among rows of one first-piece key: rows that share a piece of the second collection and
    agree in `least` places of their signatures."""
    n = len(ids)
    if n <= 256:
        eq = sig[:, None, :] == sig[None, :, :]
        tensor = eq[:, :, second:].reshape(n, n, pieces, rows).all(3).any(2)
        linked = tensor & (eq.sum(2) >= least)
        return [(int(ids[a]), int(ids[b])) for a, b in spanning(n, lambda i: np.flatnonzero(linked[i]), int(linked.sum(1).argmax()))]
    found, parent = [], list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for j in range(pieces):
        part = np.ascontiguousarray(sig[:, second + j * rows : second + (j + 1) * rows])
        _, key = np.unique(part, axis=0, return_inverse=True)
        order = np.argsort(key.ravel(), kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(key.ravel()[order])) + 1):
            if len(run) > 1:
                for a, b in bucket_edges(sig[run], least):
                    x, y = root(int(run[a])), root(int(run[b]))
                    if x != y:  # else another piece has connected them
                        parent[x] = y
                        found.append((int(ids[run[a]]), int(ids[run[b]])))
    return found


def set_edges(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning edges of all pairs with 100 * intersection >= percent * union."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    flat = np.concatenate(sets)
    _, code, freq = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(code, kind="stable")
    members, first = owner[order], np.concatenate([[0], np.cumsum(freq)])
    starts = np.cumsum(sizes) - sizes
    shared = np.add.reduceat((freq[code] > 1).astype(np.int64), starts)
    weight = np.add.reduceat(freq[code], starts)
    # a row whose shingles that occur elsewhere are too few can't be in any link
    skip = 100 * shared < percent * sizes

    def links(i):
        mine = code[starts[i] : starts[i] + sizes[i]]
        mine = mine[freq[mine] > 1]
        a, k = first[mine], freq[mine]
        e = np.cumsum(k)
        near = members[np.repeat(a - (e - k), k) + np.arange(int(e[-1]))] if len(mine) else np.zeros(0, np.int64)
        both = np.bincount(near, minlength=n)
        ok = (100 * both >= percent * (sizes + sizes[i] - both)) & (both > 0)
        ok[i] = False
        return np.flatnonzero(ok)

    if n == 2:
        return [(int(ids[0]), int(ids[1]))] if len(links(0)) else []
    return [(int(ids[a]), int(ids[b])) for a, b in spanning(n, links, int((weight / np.maximum(sizes, 1)).argmax()), skip)]


class Block:
    """Rows with their shingle sets as codes of a sorted dictionary; label: the component that a row is in so far."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, sizes: np.ndarray, names: np.ndarray, codes: np.ndarray):
        self.ids, self.label, self.sizes, self.names, self.codes = ids, label, sizes, names, codes

    @classmethod
    def built(cls, ids: np.ndarray, label: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> Block:
        names, codes = np.unique(flat, return_inverse=True)
        return cls(ids, label, sizes, names, codes.ravel())

    def publish(self, folder: str, name: str) -> None:
        _put(folder, name, ids=self.ids, label=self.label, sizes=self.sizes, names=self.names, codes=self.codes.astype(np.uint16 if len(self.names) <= 1 << 16 else np.uint32))

    @classmethod
    def read(cls, folder: str, name: str) -> Block | None:
        found = _got(folder, name)
        return found and cls(found["ids"], found["label"], found["sizes"], found["names"], found["codes"])

    def flat(self, rows: np.ndarray) -> np.ndarray:
        return self.names[self.codes[np.repeat(rows, self.sizes)]]

    def only(self, rows: np.ndarray) -> Block:
        return Block(self.ids[rows], self.label[rows], self.sizes[rows], self.names, self.codes[np.repeat(rows, self.sizes)])


def _put(folder: str, name: str, **arrays) -> None:
    """Write arrays as a file of the shared folder. A repeated task finds its file there: it holds the same rows."""
    fs, base = file_system(folder)
    if not fs.get_file_info(f"{base}/{name}").is_file:
        out = io.BytesIO()
        np.savez(out, **arrays)
        publish(folder, name, out.getvalue())


def _got(folder: str, name: str) -> dict | None:
    fs, base = file_system(folder)
    try:
        with fs.open_input_stream(f"{base}/{name}") as f:
            return dict(np.load(io.BytesIO(f.read())))
    except FileNotFoundError:
        return None  # no row of the cluster fell into this block


def cross_edges(a: Block, b: Block, percent: int) -> list[tuple[int, int]]:
    """Links between rows of two blocks; with the blocks' labels they connect the rows as all links do. Rows that a link
    connects take the label of b's row, in both blocks."""
    if not len(a.ids) or not len(b.ids):
        return []
    at = np.minimum(np.searchsorted(a.names, b.names), len(a.names) - 1)
    same = a.names[at] == b.names
    known = same[b.codes]
    a_owner, b_owner = (np.repeat(np.arange(len(x.ids)), x.sizes) for x in (a, b))
    a_codes, b_codes = a.codes.astype(np.int64), at[b.codes[known]]
    b_owner = b_owner[known]
    # a row can't be in any link if too few of its shingles occur in the other block
    in_a = np.bincount(a_codes, minlength=len(a.names)) > 0
    ask_b = 100 * np.bincount(b_owner[in_a[b_codes]], minlength=len(b.ids)) >= percent * b.sizes
    in_b = np.bincount(b_codes[ask_b[b_owner]], minlength=len(a.names)) > 0
    ask_a = 100 * np.bincount(a_owner[in_b[a_codes]], minlength=len(a.ids)) >= percent * a.sizes
    if not ask_a.any() or not ask_b.any():
        return []
    sides, out = ((a, a_owner, a_codes), (b, b_owner, b_codes)), []

    def ask(x: int, rows: np.ndarray, others: np.ndarray) -> None:
        """Rows of one side against those of the other side that are marked in `others`."""
        (left, owner, codes), (right, members, index) = sides[x], sides[1 - x]
        rows = np.flatnonzero(rows)
        if not len(rows) or not others.any():
            return
        picked = others[members]
        order = np.argsort(index[picked], kind="stable")
        members = members[picked][order]
        first = np.concatenate([[0], np.cumsum(np.bincount(index[picked], minlength=len(a.names)))])
        for i, start, end in zip(rows, np.searchsorted(owner, rows), np.searchsorted(owner, rows, side="right")):
            if not (right.label[others] != left.label[i]).any():
                continue
            mine = codes[start:end]
            k = first[mine + 1] - first[mine]
            mine, k = mine[k > 0], k[k > 0]
            if not len(mine):
                continue
            e = np.cumsum(k)
            both = np.bincount(members[np.repeat(first[mine] - (e - k), k) + np.arange(int(e[-1]))], minlength=len(right.ids))
            ok = (100 * both >= percent * (right.sizes + left.sizes[i] - both)) & (both > 0)
            for j in np.flatnonzero(ok):
                if left.label[i] != right.label[j]:
                    out.append((int(left.ids[i]), int(right.ids[j])))
                    old, new = (left.label[i], right.label[j])[:: -1 if x else 1]
                    for block in (a, b):
                        block.label[block.label == old] = new

    main_a, main_b = (x.label == _most(x.label) for x in (a, b))
    ask(0, ask_a & main_a, ask_b & main_b)
    ask(0, ask_a & ~main_a, ask_b)
    ask(1, ask_b & ~main_b, ask_a & main_a)
    return out


def _most(label: np.ndarray):
    values, counts = np.unique(label, return_counts=True)
    return values[counts.argmax()]


def _labels(ids: np.ndarray, edges: list[tuple[int, int]]) -> np.ndarray:
    """The smallest id that each id is connected with."""
    parent = {int(i): int(i) for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in edges:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return np.array([root(int(i)) for i in ids], np.int64)


def _runs(batches, keys: int):
    """Runs of rows with equal first `keys` columns from sorted batches: (key, columns as lists of arrays)."""
    import pyarrow as pa

    held = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is None or any(c[0] != x for c, x in zip(cols, last))
        at = 0
        for edge in [*np.flatnonzero(new).tolist(), batch.num_rows]:
            if edge > at:
                held.append(batch.slice(at, edge - at))
            if edge < batch.num_rows and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = edge
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _edge_batch(edges):
    import pyarrow as pa

    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, pieces: int = 10, rows: int = 2, block_shingles: int = 40_000, hot: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id for every row. Words are lower-cased in A-Z.

    First pieces of over about `hot` classes are dealt by both pieces; the edges connect the same rows either way.
    """
    hashes = 2 * pieces * rows
    share = percent / 100
    least = int(hashes * share - 4.4 * (hashes * share * (1 - share)) ** 0.5)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sign(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                flat, sizes = shingle_sets([t or "" for t in batch.column(1).to_pylist()], shingle)
                h = minhashes(flat, sizes, hashes)
                ends, keys, sigs, firsts, k = np.cumsum(sizes), [], [], [], 0
                small = (h >> np.uint64(56)).astype(np.uint8)
                heads = np.zeros((len(h), pieces), np.uint64)
                for i in range(pieces):
                    key = np.full(len(h), i + 1, np.uint64)
                    for r in range(rows):
                        key = mix(key * _K + h[:, i * rows + r])
                    heads[:, i] = key
                heads = heads.view(np.int64)
                for n, e in zip(sizes, ends):
                    if n:
                        keys.append(hashlib.blake2b(flat[e - n : e].tobytes(), digest_size=16).digest())
                        sigs.append(small[k].tobytes())
                        firsts.append(heads[k])
                        k += 1
                    else:
                        keys.append(None)
                        sigs.append(None)
                        firsts.append(None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "sig", "heads"])

    ws = Workspace(docs.sparkSession, "near-duplicates")
    signed = ws.saved(source.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, sig binary, heads array<long>"), "minhash")
    # one class for each distinct set; sig and heads are functions of the set
    classes = signed.filter("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("heads").alias("heads"))
    classes = ws.saved(classes, "minhash-classes")
    dealt = classes.select(F.explode("heads").alias("head"), "rep", "sig")

    def match(batches):
        found = []
        for run in _runs(_narrow(batches), 1):
            if run.num_rows < 2:
                continue
            found += signature_edges(run.column(1).to_numpy(), _signatures(run.column(2), hashes), pieces * rows, pieces, rows, least)
            if len(found) > 50_000:
                yield _edge_batch(found)
                found = []
        yield _edge_batch(found)

    def match_bucket(batches):
        found = []
        for run in _runs(_narrow(batches), 1):
            if run.num_rows > 1:
                ids = run.column(1).to_numpy()
                found += [(int(ids[a]), int(ids[b])) for a, b in bucket_edges(_signatures(run.column(2), hashes), least)]
            if len(found) > 50_000:
                yield _edge_batch(found)
                found = []
        yield _edge_batch(found)

    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # a sample is enough to find the hot keys: both ways are whole
    share = min(1.0, 10_000 / hot)
    counted = (classes.sample(share, 1) if share < 1 else classes).select(F.explode("heads").alias("head")).groupBy("head").count()
    crowded = [r["head"] for r in counted.filter(F.col("count") > hot * share).select("head").collect()]
    few = dealt.filter(~F.col("head").isin(crowded)) if crowded else dealt
    candidates = few.repartition(n_parts, "head").sortWithinPartitions("head").mapInArrow(match, "a long, b long")
    if crowded:
        # one key for each table's bucket; two buckets under one key would only be matched together
        second = F.substring("sig", F.lit(pieces * rows + 1) + F.col("j") * rows, F.lit(rows))
        buckets = dealt.filter(F.col("head").isin(crowded)).select("head", "rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("j")).select(F.xxhash64("head", "j", second).alias("bucket"), "rep", "sig")
        candidates = candidates.unionByName(buckets.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(match_bucket, "a long, b long"))
    clusters = components(candidates).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = ws.saved(clusters.join(classes.select("rep", "size"), "rep"), "minhash-clusters")
    total = members.groupBy("cluster").agg(F.ceil(F.sum("size") / block_shingles).cast("int").alias("blocks"))
    placed = ws.saved(members.join(total, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "minhash-placed")
    reps = source.filter("doc_id IS NOT NULL").withColumnRenamed("doc_id", "rep")

    folder = f"{ws.base}/blocks"

    def shingles(batches):
        import pyarrow as pa

        for whole in _narrow(batches):
            for batch in slices(whole, "text"):
                flat, sizes = shingle_sets([t or "" for t in batch.column(4).to_pylist()], shingle)
                ends = np.cumsum(sizes)
                sets = [flat[e - n : e].tobytes() for n, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(sets, pa.binary())], names=["cluster", "block", "blocks", "rep", "set"])

    def confirm(batches):
        """All pairs inside each block; blocks of larger clusters are kept as files with their components so far."""
        found = []
        for run in _runs(_narrow(shingles(batches)), 2):
            sets = [np.frombuffer(s, np.uint64) for s in run.column(4).to_pylist()]
            # a row that repeats an id may have no shingles
            some = np.array([len(s) > 0 for s in sets])
            ids, sets = run.column(3).to_numpy()[some], [s for s in sets if len(s)]
            edges = set_edges(ids, sets, percent) if len(ids) > 1 else []
            if run.column(2)[0].as_py() > 1 and len(ids):
                cluster, block = (run.column(i)[0].as_py() for i in range(2))
                Block.built(ids, _labels(ids, edges), np.fromiter(map(len, sets), np.int64, len(sets)), np.concatenate(sets)).publish(f"{folder}/{cluster}", f"{block}.sets")
            found += edges
            if len(found) > 50_000:
                yield _edge_batch(found)
                found = []
        yield _edge_batch(found)

    def confirm_first(batches):
        """The blocks of each unit against the cluster's first block."""
        for batch in batches:
            for cluster, unit, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                first = Block.read(f"{folder}/{cluster}", "0.sets")
                for k in range(max(1, unit * UNIT), min(blocks, (unit + 1) * UNIT)) if first else ():
                    block = Block.read(f"{folder}/{cluster}", f"{k}.sets")
                    if block:
                        yield _edge_batch(cross_edges(block, first, percent))

    def label(batches):
        """A file for each block: its ids, their components and which are outside of the cluster's largest one."""
        import pyarrow as pa

        for run in _runs(_narrow(batches), 3):
            cluster, block, blocks = (run.column(i)[0].as_py() for i in range(3))
            ids, component, rest = (run.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
            order = np.argsort(ids, kind="stable")
            _put(f"{folder}/{cluster}", f"{block}.labels", ids=ids[order], label=component[order], rest=rest[order])
            yield pa.RecordBatch.from_arrays([pa.array([cluster], pa.int64()), pa.array([block], pa.int32()), pa.array([blocks], pa.int32()), pa.array([int(rest.sum())], pa.int64())], names=["cluster", "block", "blocks", "rests"])

    def labelled(cluster, k):
        block = Block.read(f"{folder}/{cluster}", f"{k}.sets")
        if not block:
            return None, None
        known = _got(f"{folder}/{cluster}", f"{k}.labels")
        at = np.searchsorted(known["ids"], block.ids)
        block.label = known["label"][at]
        return block, known["rest"][at]

    def confirm_rest(batches):
        """The rest rows of each unit against all blocks but the first, which every block was held against; two units'
        rest rows meet once, in the first one's task."""
        for batch in batches:
            for cluster, unit, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                mine = range(max(1, unit * UNIT), min(blocks, (unit + 1) * UNIT))
                own = [(b, rest) for b, rest in (labelled(cluster, k) for k in mine) if b and rest.any()]
                if not own:
                    continue
                flat = np.concatenate([b.flat(rest) for b, rest in own])
                held = Block.built(*(np.concatenate([getattr(b, c)[rest] for b, rest in own]) for c in ("ids", "label", "sizes")), flat)
                for k in range(1, blocks):
                    block, rest = labelled(cluster, k)
                    if block:
                        yield _edge_batch(cross_edges(held, block.only(~rest) if k < mine[0] else block, percent))

    # always by a shuffle: the members grow with the corpus, so a broadcast at small sizes would only hide that
    full = placed.hint("merge").join(reps, "rep").select("cluster", "block", "blocks", "rep", "text")
    links = ws.saved(full.repartition(n_parts, "cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(confirm, "a long, b long"), "minhash-links")
    unit = F.floor(F.col("block") / UNIT).cast("int").alias("unit")

    def by_unit(rows, work):
        return rows.select("cluster", unit, "blocks").distinct().repartition(n_parts, "cluster", "unit").mapInArrow(work, "a long, b long")

    several = placed.filter("blocks > 1")
    if not several.isEmpty():
        links = links.unionByName(ws.saved(by_unit(several, confirm_first), "minhash-first-links"))
    several = placed.filter("blocks > 2")
    if not several.isEmpty():
        so_far = components(links).withColumnRenamed("node", "rep")
        parts = ws.saved(several.join(so_far, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "minhash-parts")
        size = parts.groupBy("cluster", "component").agg(F.sum("size").alias("n"))
        main = size.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("components")).filter("components > 1")
        rows = parts.join(main, "cluster").select("cluster", "block", "blocks", "rep", "component", (F.col("component") != F.col("m.component")).alias("rest"))
        rows = rows.repartition(n_parts, "cluster", "block").sortWithinPartitions("cluster", "block").mapInArrow(label, "cluster long, block int, blocks int, rests long")
        rests = ws.saved(rows, "minhash-labels").filter("block > 0 AND rests > 0")
        links = links.unionByName(ws.saved(by_unit(rests, confirm_rest), "minhash-rest-links"))
    found = components(links).select(F.col("node").alias("rep"), "component")
    named = classes.select("set_key", "rep").join(found, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    result = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return ws.result(result, "near-duplicates")


def _narrow(batches, limit: int = 32 << 20):
    """Batches cut so that none holds over about `limit` bytes."""
    for b in batches:
        step = max(1, int(b.num_rows * limit / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents without those that have a near duplicate of a smaller id; columns as given, whatever their names."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **settings)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("id"))
    return rows.join(gone.hint("merge"), "id", "left_anti").select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' classes: 3-word shingles, similarity of 85 % or more."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) m ON d.doc_id = m.node LEFT JOIN n ON d.doc_id = n.doc_id
"""
