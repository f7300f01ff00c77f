"""N-gram Jaccard join by a prefix tree, on sets of word shingles.

1. Tasks hash each text's distinct shingles and send them, packed, to hash buckets; a bucket's task finds the shingles of
   several texts and tells each of those texts the shingle and how many have it.  (Very frequent ones are found first, are
   known to all tasks and aren't sent.)  A text whose own shingles are too many can't link and goes no further.
2. Sets are ordered globally, the rarest shingle first; two linked sets share one within their prefixes.  Texts of equal
   sets are one class.  Classes that share prefix shingles are candidates; candidates' components are blocks.
3. A block's sets are stored in a compressed prefix tree, the block's commonest shingle first.  A set is matched against
   the tree from the root: a node's overlap is counted once for all sets below it, and a subtree is left when its overlap
   and all that can still follow don't reach what its shortest set needs.  Sets known to be connected aren't told apart:
   all sets but those of the block's largest component are matched, so no link between components is missed.
   Blocks over BLOCK_TOKENS are taken apart: into the groups of sets that share a prefix shingle (groups of the same sets
   are one), or into parts of which each pair is matched in a task of its own, whichever sends fewer shingles.
4. The links' components give the classes of documents.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, small, stored, table
from .components import components
from .words import LOWER, Words, mixed, released, sliced

SHINGLE, PERCENT = 5, 75
#: Shingles of a bucket, bytes of texts of a chunk and of a map block, shingles of a block's part and of a task's blocks.
BUCKET, CHUNK, BLOCK, BLOCK_TOKENS = 2_000_000, 24 << 20, 3 << 20, 1_500_000
#: Map blocks and buckets grow together, up to GROWTH times, from STEADY buckets on, so that blocks have several shingles for each bucket.
STEADY, GROWTH = 4_000, 16
#: Shingles that are counted together when frequent ones are looked for.
COUNTED = 2_000_000
#: A shingle is frequent if more than this part of all texts have it (at least FREQUENT_AT_LEAST texts).
FREQUENT, FREQUENT_AT_LEAST, FREQUENT_MOST = 0.001, 50, 500_000


def sets_of(w: Words, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer than k words is one shingle, one without words has none."""
    h = w.hashes()
    g = w.windows(h, k)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            s = np.sort(g[a : b - k + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            s = mixed(w.windows(h[a:b], int(b - a), 0xBF58476D1CE4E5B9) + np.uint64(b - a))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out


def pack(x: np.ndarray) -> bytes:
    d = np.diff(np.asarray(x, np.int64), prepend=np.int64(0)).view(np.uint64)
    d = (d << np.uint64(1)) ^ (np.uint64(0) - (d >> np.uint64(63)))
    return zlib.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1)
    d = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(((d >> np.uint64(1)) ^ (np.uint64(0) - (d & np.uint64(1)))).view(np.int64))


def _all(t: pa.Table, column: str, read) -> np.ndarray:
    parts = [read(b) for b in t.column(column).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


_raw = lambda b: np.frombuffer(b, np.uint64)
_PACKED = "kind int, key long, rows binary, a binary, b binary, c binary"
_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("rows", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_LIGHT, _DOC, _FREQUENT, _SHARED = range(4)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def _runs(key: np.ndarray):
    """(key, from, to) of each run of a sorted array."""
    edges = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)) if len(key) else []
    return [(int(key[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)] if len(key) else []


def grown(buckets: float) -> float:
    """How many times larger blocks and buckets are, for so many buckets of usual size."""
    return min(GROWTH, max(1.0, math.sqrt(buckets / STEADY)))


def _frequent(k: int):
    """Shingles of at least half of FREQUENT's part of the texts counted together, of two texts at least; so a shingle in
    FREQUENT of all texts has half its count or more, or is less than two in COUNTED of all shingles."""

    def counted(held: list[np.ndarray], texts: int):
        g, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        at = n >= max(2, texts * FREQUENT / 2)
        return pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(n[at].astype(np.int64))], names=["g", "n"])

    def run(batches):
        held, texts, size = [], 0, 0
        for t in sliced(batches, BLOCK):
            held += sets_of(Words(t.column("text"), LOWER), k)
            texts, size = texts + t.num_rows, size + sum(map(len, held[len(held) - t.num_rows :]))
            if size > COUNTED:
                yield counted(held, texts)
                held, texts, size = [], 0, 0
        yield counted(held, texts)
        held.clear()
        released()

    return run


def _shingle(k: int, block: int, buckets: int, chunks: int, frequent):
    def run(batches):
        often: np.ndarray = frequent.value
        bits = np.zeros(1 << 20, bool)
        bits[often & np.uint64((1 << 20) - 1)] = True
        for t in sliced(batches, block):
            key, th = (np.asarray(t.column(c).combine_chunks(), np.int64) for c in ("key", "th"))
            sets = sets_of(Words(t.column("text"), LOWER), k)
            n = np.array([len(s) for s in sets], np.int64)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            ids, out = t.column("doc_id").to_pylist(), []
            chunk = key % chunks
            order = np.argsort(chunk, kind="stable")
            for c, a, b in _runs(chunk[order]):
                at = order[a:b]
                has = np.array([ids[i] is not None for i in at], np.int64)
                out.append((_DOC, c, pack(key[at]), pack(n[at]), pack(np.array([ids[i] or 0 for i in at], np.int64)) + b"|" + np.packbits(has.astype(bool)).tobytes(), b"".join(digest[i] for i in at) + th[at].tobytes()))
            g = np.concatenate([np.zeros(0, np.uint64), *sets])
            own = np.repeat(key, n)
            maybe = np.flatnonzero(bits[g & np.uint64((1 << 20) - 1)])
            at = np.searchsorted(often, g[maybe])
            hit = maybe[often[np.minimum(at, len(often) - 1)] == g[maybe]] if len(often) else maybe[:0]
            chunk = own[hit] % chunks
            order = np.argsort(chunk, kind="stable")
            for c, a, b in _runs(chunk[order]):
                out.append((_FREQUENT, c, pack(own[hit][order[a:b]]), g[hit][order[a:b]].tobytes(), None, None))
            rest = np.ones(len(g), bool)
            rest[hit] = False
            g, own = g[rest], own[rest]
            home = (mixed(g) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(home, kind="stable")
            g, own = g[order], own[order]
            for c, a, b in _runs(home[order]):
                out.append((_LIGHT, c, pack(own[a:b]), g[a:b].tobytes(), None, None))
            yield _batch(out)

    return run


def _count(chunks: int):
    def run(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() != _LIGHT:
            return t
        own, g = _all(t, "rows", unpack), _all(t, "a", _raw)
        order = np.argsort(g)
        own, g = own[order], g[order]
        first = np.concatenate([[True], g[1:] != g[:-1]])
        size = np.diff(np.append(np.flatnonzero(first), len(g)))
        n = np.repeat(size, size)
        own, g, n = own[n > 1], g[n > 1], n[n > 1]
        chunk = own % chunks
        order = np.lexsort((own, chunk))
        own, g, n, out = own[order], g[order], n[order], []
        for c, a, b in _runs(chunk[order]):
            out.append((_SHARED, c, pack(own[a:b]), g[a:b].tobytes(), pack(n[a:b]), None))
        return pa.Table.from_batches([_batch(out)])

    return run


_SETS = "key long, doc_id long, th long, n long, digest binary, grams binary, prefix array<long>"
_SETS_ARROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("grams", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def prefix_size(n: int, percent: int) -> int:
    """A set of n needs one of its first so many shingles in any set it links with."""
    return n - -(-percent * n // 100) + 1


def _assemble(percent: int):
    def run(t: pa.Table) -> pa.Table:
        kind = np.asarray(t.column("kind").combine_chunks())
        docs, often, light = (t.filter(pa.array(kind == k)) for k in (_DOC, _FREQUENT, _SHARED))
        own = np.concatenate([_all(light, "rows", unpack), _all(often, "rows", unpack)]).astype(np.int64)
        g = np.concatenate([_all(light, "a", _raw).astype(np.uint64), _all(often, "a", _raw).astype(np.uint64)])
        df = _all(light, "b", unpack).astype(np.int64)
        df = np.concatenate([df, np.full(len(g) - len(df), 2**62)])
        order = np.lexsort((g, df, own))
        own, g = own[order], g[order]
        out = []
        for row in docs.to_pylist():
            keys, ns = unpack(row["rows"]), unpack(row["a"])
            mask = math.ceil(len(keys) / 8)
            ids, has = unpack(row["b"][: -mask - 1]), np.unpackbits(np.frombuffer(row["b"][-mask:], np.uint8))
            ths = np.frombuffer(row["c"], np.int64, offset=16 * len(keys)).tolist()
            for i, (k, n) in enumerate(zip(keys.tolist(), ns.tolist(), strict=True)):
                a, b = np.searchsorted(own, [k, k + 1])
                doc = int(ids[i]) if has[i] else None
                take = prefix_size(n, percent) - (n - (b - a))
                if n and take > 0:
                    out.append((k, doc, ths[i], n, row["c"][16 * i : 16 * i + 16], g[a:b].tobytes(), g[a : a + take].view(np.int64)))
                else:
                    out.append((k, doc, ths[i], n, None, None, None))
        cols = list(zip(*out, strict=True)) or [[]] * len(_SETS_ARROW)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SETS_ARROW, strict=True)], schema=_SETS_ARROW)

    return run


class PrefixTree:
    """A compressed tree of sorted rank sequences, each with its set's full size."""

    def __init__(self, seqs: list[np.ndarray], sizes: np.ndarray):
        self.seqs, self.sizes = seqs, sizes
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        top: list[tuple] = []
        todo = [(order, 0, top)]
        while todo:
            ids, depth, siblings = todo.pop()
            a, b = seqs[ids[0]][depth:], seqs[ids[-1]][depth:]
            n = min(len(a), len(b))
            other = np.flatnonzero(a[:n] != b[:n])
            same = int(other[0]) if len(other) else n
            at, end, groups, last = depth + same, [], [], -1
            for i in ids:
                s = seqs[i]
                if len(s) == at:
                    end.append(i)
                elif s[at] == last:
                    groups[-1].append(i)
                else:
                    last = int(s[at])
                    groups.append([i])
            #: ranks of the edge, ids of the sets that end here, children, least size below, most ranks after the edge
            node = (a[:same], end, [], int(sizes[ids].min()), max(len(seqs[i]) for i in ids) - at)
            siblings.append(node)
            todo += [(x, at, node[2]) for x in groups]
        self.root = top[0]

    def linked(self, probe: int, marks: np.ndarray, percent: int) -> list[int]:
        """Sets whose Jaccard similarity with the probe is percent or more (itself too).  marks: zeros, one for each rank."""
        mine, size, out = self.seqs[probe], int(self.sizes[probe]), []
        marks[mine] = 1
        todo = [(self.root, 0, len(mine))]
        while todo:
            (edge, end, children, least, after), overlap, left = todo.pop()
            if len(edge):
                got = int(marks[edge].sum())
                overlap += got
                left = len(mine) - int(np.searchsorted(mine, edge[-1], "right"))
            if (100 + percent) * (overlap + min(left, after)) < percent * (size + least):
                continue
            out += [i for i in end if (100 + percent) * overlap >= percent * (size + int(self.sizes[i]))]
            todo += [(c, overlap, left) for c in children]
        marks[mine] = 0
        return out


def block_links(sets: list[np.ndarray], sizes: np.ndarray, percent: int, part: np.ndarray | None = None) -> list[int]:
    """For each set the least index of its component in the block.  part: 0 or 1; only pairs of two parts matter then."""
    ranks, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    rank_of = np.empty(len(counts), np.int64)
    rank_of[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    ranks, edges = rank_of[ranks], np.cumsum([0, *map(len, sets)])
    seqs = [np.sort(ranks[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    tree, marks, root = PrefixTree(seqs, sizes), np.zeros(len(counts), np.int8), list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    weight, todo, most = [1] * len(sets), list(range(len(sets))), 0
    order = sorted(todo, key=lambda i: -len(sets[i]))
    unprobed: list[int] = []  # left out in earlier rounds too: another component may become the largest
    while order:
        kept = []
        for i in order:
            if find(i) == find(most) and weight[find(i)] > 1:
                kept.append(i)  # of the largest component so far
                continue
            for j in tree.linked(i, marks, percent):
                a, b = find(i), find(j)
                if a != b and (part is None or part[i] != part[j]):
                    a, b = min(a, b), max(a, b)
                    root[b] = a
                    weight[a] += weight[b]
            if weight[find(i)] > weight[find(most)]:
                most = i
        now = set(order)
        unprobed = [i for i in unprobed if i not in now] + kept
        order = [i for i in unprobed if find(i) != find(most)]
    return [find(i) for i in range(len(sets))]


def _verify(percent: int):
    def run(t: pa.Table) -> pa.Table:
        group, key, n, part = (np.asarray(t.column(c).combine_chunks()) for c in ("task", "key", "n", "part"))
        grams = t.column("grams").to_pylist()
        order = np.lexsort((key, group))
        a_out, b_out = [], []
        for _, a, b in _runs(group[order]):
            at = order[a:b]
            if len(at) > 1:
                side = part[at] if (part[at] != part[at[0]]).any() else None
                root = block_links([_raw(grams[i]) for i in at], n[at], percent, side)
                far = [i for i, r in enumerate(root) if r != i]
                a_out += key[at[far]].tolist()
                b_out += key[at[[root[i] for i in far]]].tolist()
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    return run


def _links(reps: DataFrame, percent: int, block_tokens: int) -> DataFrame:
    """a, b: links (or pairs known to be connected by links) that connect what all links between the classes connect."""
    tokens = F.octet_length("grams") / 8
    postings = reps.select("key", tokens.alias("tokens"), F.explode("prefix").alias("gram"))
    by_gram = postings.groupBy("gram").agg(F.min("key").alias("hub"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum("tokens").alias("t"))
    hubs = stored(by_gram.where("c > 1"), "jaccard-hubs")
    # a shingle's sets meet at its first one: a short list of pairs that connects them
    pairs = postings.join(hubs.select("gram", "hub"), "gram").where("key <> hub")
    found = components(pairs.select(F.col("key").alias("a"), F.col("hub").alias("b")))
    nodes = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "key")
    blocks = stored(nodes.join(reps.select("key", tokens.alias("tokens")), "key"), "jaccard-blocks")
    sizes = blocks.groupBy("root").agg(F.sum("tokens").alias("t"))
    large = stored(sizes.where(F.col("t") > block_tokens).withColumn("parts", F.ceil(F.col("t") / block_tokens)), "jaccard-large")
    home = blocks.select("key", F.xxhash64(F.lit(0), "root").alias("block"))
    if large.limit(1).count():
        groups = hubs.join(blocks.select(F.col("key").alias("hub"), "root").join(large, "root").select("hub", "root", "parts"), "hub")
        groups = groups.groupBy("root", "parts", "hub", "c", "x").agg(F.min("gram").alias("gram"), F.min("t").alias("t"))  # of one membership one
        cost = groups.groupBy("root").agg(F.sum(F.col("t") * F.ceil(F.col("t") / block_tokens)).alias("cost"))
        apart = stored(large.join(cost, "root").where(F.col("cost") < F.col("t") * F.col("parts")).select("root"), "jaccard-apart")
        groups = stored(groups.join(apart, "root", "left_semi").select("gram"), "jaccard-groups")
        home = blocks.join(apart, "root", "left_anti").select("key", F.xxhash64(F.lit(0), "root").alias("block"))
        home = home.unionByName(postings.join(groups, "gram").select("key", F.xxhash64(F.lit(1), "gram").alias("block")))
    home = stored(home, "jaccard-home")
    held = home.join(reps.select("key", "n", "grams"), "key")
    parts = home.join(reps.select("key", tokens.alias("tokens")), "key").groupBy("block").agg(F.ceil(F.sum("tokens") / block_tokens).cast("int").alias("parts"))
    parts = stored(parts.where("parts > 1"), "jaccard-parts")
    held = held.join(parts, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    held = held.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a part meets each other part in a task; with itself it meets in (mine, mine)
    pair = F.xxhash64("block", F.least("mine", "other"), F.greatest("mine", "other"))
    bins = max(1, math.ceil((reps.agg(F.sum(tokens)).first()[0] or 0) / block_tokens * 2))
    held = held.select(pair.alias("task"), "key", "n", "grams", F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("part"), F.when(F.col("parts") > 1, pair).otherwise(F.pmod("block", F.lit(bins))).alias("bin"))
    return held.groupBy("bin").applyInArrow(_verify(percent), "a long, b long")


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least id of a row reachable by links, itself included), kept (one row of each component), th (a hash of the text).

    Null texts and texts without words have the empty set and link with nothing.  Rows equal in id are told apart; null
    ids come after all others, so a component's id is null only if all its ids are; of a component's rows of the least id the first
    in the input stays.  An empty table gives no rows.  Hashes have 64 bits: that two given sets of 10,000 shingles seem to
    share one that they don't has a chance under 1 in 10**11.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("th"))
    size, total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    larger = grown(size / 6 / BUCKET)
    buckets, chunks = max(1, math.ceil(size / 6 / BUCKET / larger)), max(1, math.ceil(size / CHUNK / larger)) | 1
    often = rows.select("text").mapInArrow(_frequent(shingle), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    often = often.where(F.col("n") >= max(FREQUENT_AT_LEAST, int(total * FREQUENT / 2))).orderBy(F.desc("n"), "g").limit(FREQUENT_MOST).select("g").collect()
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r.g for r in often], np.int64).view(np.uint64)))  # FREQUENT_MOST at most; any set of them is right
    packed = rows.withColumn("key", F.monotonically_increasing_id()).mapInArrow(_shingle(shingle, int(BLOCK * larger), buckets, chunks, frequent), _PACKED)
    told = packed.groupBy("kind", "key").applyInArrow(_count(chunks), _PACKED)
    sets = stored(told.groupBy("key").applyInArrow(_assemble(percent), _SETS), "jaccard-sets")

    able = sets.where("digest is not null")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("m")
    classes = stored(able.groupBy("digest").agg(F.min("key").alias("key"), least), "jaccard-classes")
    reps = stored(able.join(classes.select("key"), "key", "left_semi").select("key", "n", "grams", "prefix"), "jaccard-sets")
    linked = components(_links(reps, percent, block_tokens))

    # joins of written tables: a class or component that holds many rows is split between tasks by adaptive execution
    roots = stored(classes.join(linked.withColumnRenamed("node", "key"), "key", "left").select("digest", "m", F.coalesce("root", "key").alias("root")), "jaccard-roots")
    best = stored(roots.groupBy("root").agg(F.min("m").alias("best")), "jaccard-best")
    told = stored(roots.select("digest", "root").join(best, "root").select("digest", "best"), "jaccard-told")
    out = able.select("key", "doc_id", "th", "n", "digest").join(told, "digest")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), (F.col("key") == F.col("best.key")).alias("kept"), "th")
    alone = sets.where("digest is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "th")
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that jaccard_join() keeps, with all their columns; of rows equal in id and text one stays.

    The rows that go are told by id and text hash; few of them are broadcast, many are joined, and texts are shuffled
    then only."""
    told = jaccard_join(docs, id_col=id_col, text_col=text_col, **options)
    fate = told.groupBy("doc_id", "th").agg(F.count("*").alias("rows"), F.count_if("kept").alias("stay"))
    fate = stored(fate.where("stay = 0 or rows > 1").withColumn("stay", F.col("stay") > 0), "jaccard-fate")
    rows = fate.count()
    boxes = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_th"))

    def same(other: DataFrame):
        return boxes["_id"].eqNullSafe(other["doc_id"]) & (boxes["_th"] == other["th"])

    out = boxes.join(small(fate, rows), same(fate), "left_anti")
    again = fate.where("stay")
    if rows and again.limit(1).count():
        out = out.unionByName(boxes.join(small(again, rows), same(again), "left_semi").dropDuplicates(["_id", "_th"]))
    return out.select("row.*")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + {SHINGLE - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)) + 1)) AS s FROM d)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""
