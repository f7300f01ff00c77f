"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text.  An item's seeds are its n-grams of
LONG words, all of them, and those of SHORT words that are rare: a pass over the corpus counts in how many documents each
n-gram of the items occurs, and RARE of them at most (a part of all) have a rare one.  A second pass looks the seeds up in
each document and aligns the words around those that occur with the item's.  The words that these and the item share are
counted first, and the alignment is left out if even all of them in order wouldn't be a copy.  An item of under MIN_WORDS words must be there word for word, one of under LONG words must be all of the text.  The
items go to the tasks in blocks of bounded size; each block is one more pass over the documents, and no document is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import PLAIN, Words, sliced

#: Words of a seed, and of the shortest item whose edited copies count.
LONG, SHORT, MIN_WORDS = 3, 2, 8
RARE, RARE_AT_LEAST = 0.001, 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least part of an item's best possible alignment score that counts as a copy.
THRESHOLD = 0.5
#: Bytes of items in a block, so of what is broadcast.
ITEM_BYTES = 16 << 20
_BITS = 1 << 20
_FOUND = "array<struct<item_id:bigint,score:double,start:int,end:int,seeds:int>>"
_FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("seeds", pa.int32())]))


def folded(texts) -> Words:
    return Words(pc.utf8_lower(texts), PLAIN)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, end of that alignment in words, the first of the best)."""
    ramp = np.arange(len(words) + 1) * -GAP
    row, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for w in item:
        new = np.zeros_like(row)
        new[1:] = row[:-1] + np.where(words == w, MATCH, MISMATCH)
        np.maximum(new, row + GAP, out=new)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + ramp) - ramp  # gaps in the item: linear, so a running maximum
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


class Seeds:
    """n-gram hashes of one length, each with its number among all seeds of the block."""

    def __init__(self, size: int, grams: np.ndarray, number: np.ndarray):
        self.size, self.grams, self.number = size, grams, number
        self.bits = np.zeros(_BITS, bool)
        self.bits[grams & np.uint64(_BITS - 1)] = True

    def hits(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, number) of each of the texts' n-grams that is among ours."""
        g = w.windows(h, self.size)
        at = np.flatnonzero(self.bits[g & np.uint64(_BITS - 1)])
        if not len(at) or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        ok = self.grams[k] == g[at]
        at, k = at[ok], k[ok]
        ok = at + self.size <= w.first[np.searchsorted(w.first, at, "right")]
        return at[ok], self.number[k[ok]]


class Items:
    """A block of items: their words, and a lookup from n-gram hash to (item, offset)."""

    def __init__(self, rows: list):
        w = folded(pa.array([r.text for r in rows], pa.string()))
        h = w.hashes()
        long_enough = np.flatnonzero(w.count >= LONG)
        self.ids = [rows[i].item_id for i in long_enough]
        self.words = [h[w.first[i] : w.first[i + 1]] for i in long_enough]
        self.tiny: dict[bytes, list] = {}
        for i in np.flatnonzero((w.count > 0) & (w.count < LONG)):
            self.tiny.setdefault(h[w.first[i] : w.first[i + 1]].tobytes(), []).append(rows[i].item_id)
        self.seeds, self.item, self.offset, begin, n = [], [], [], [], 0
        for size in (LONG, SHORT):
            item = np.concatenate([np.zeros(0, int), *(np.full(w.count[i] - size + 1, k) for k, i in enumerate(long_enough))])
            offset = np.concatenate([np.zeros(0, int), *(np.arange(w.count[i] - size + 1) for i in long_enough)])
            gram = w.windows(h, size)[w.first[long_enough][item] + offset] if len(item) else np.zeros(0, np.uint64)
            order = np.lexsort((offset, item, gram))
            grams, first = np.unique(gram[order], return_index=True)
            begin.append(first + sum(map(len, self.item)))
            self.item.append(item[order])
            self.offset.append(offset[order])
            self.seeds.append(Seeds(size, grams, np.arange(len(grams)) + n))
            n += len(grams)
        self.item, self.offset = np.concatenate(self.item), np.concatenate(self.offset)
        self.begin, self.number = np.append(np.concatenate(begin), len(self.item)), n
        self.bags = [np.unique(x, return_counts=True) for x in self.words]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, word in the text, n-gram's number) of each n-gram of the texts that is among ours, and all word hashes."""
        h = w.hashes()
        at, k = map(np.concatenate, zip(*(s.hits(w, h) for s in self.seeds), strict=True))
        order = np.argsort(at, kind="stable")
        at, k = at[order], k[order]
        text = np.searchsorted(w.first, at, "right") - 1
        return text, at - w.first[text], k, h

    def drop_frequent(self, numbers: np.ndarray) -> None:
        """Short n-grams with these numbers are no seeds; long ones all are."""
        short = self.seeds[1]
        stay = ~np.isin(short.number, numbers)
        self.seeds[1] = Seeds(SHORT, short.grams[stay], short.number[stay])

    def shared(self, i: int, words: np.ndarray) -> int:
        """How many words of item i can have a word of their own among `words`: no alignment matches more."""
        mine, n = self.bags[i]
        k = np.minimum(np.searchsorted(mine, words), len(mine) - 1)
        return int(np.minimum(n, np.bincount(k[mine[k] == words], minlength=len(mine))).sum())

    def found(self, doc: np.ndarray, pos: np.ndarray, k: np.ndarray) -> list[dict]:
        """Items with a copy in the words `doc` around the hits at pos."""
        reps = self.begin[k + 1] - self.begin[k]
        entry = np.repeat(self.begin[k], reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        pos, item, offset = np.repeat(pos, reps), self.item[entry], self.offset[entry]
        order = np.lexsort((pos, item))
        pos, item, offset = pos[order], item[order], offset[order]
        edges, out = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item)), []
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            i = item[first]
            words, p = self.words[i], pos[first:last]
            least = (THRESHOLD if len(words) >= MIN_WORDS else 1.0) * len(words)
            begins = p - offset[first:last]
            n, best = len(words), (0, 0, 0, 0)
            at = 0
            while at < len(p):  # one stretch of at most three items' length at a time
                to = int(np.searchsorted(p, p[at] + 3 * n, "right"))
                gap = np.flatnonzero(np.diff(p[at:to]) > n)
                to = at + int(gap[0]) + 1 if len(gap) else to
                lo = max(0, int(begins[at:to].min()) - n // 2, int(p[at]) - 2 * n)
                hi = min(len(doc), int(p[to - 1]) + LONG + n + n // 2)
                if self.shared(i, doc[lo:hi]) >= least:
                    score, end = align(words, doc[lo:hi])
                    if score > best[0]:
                        best = (score, lo, lo + end, to - at)
                at = to
            if best[0] >= MATCH * least:
                _, back = align(words[::-1], doc[best[1] : best[2]][::-1])
                out.append({"item_id": self.ids[i], "score": best[0] / (MATCH * n), "start": best[2] - back, "end": best[2], "seeds": best[3]})
        return out


def _frequencies(shared):
    """In how many of a task's texts each short n-gram occurs."""

    def run(batches):
        items: Items = shared.value
        first = len(items.seeds[0].grams)  # short ones have the numbers from here on
        seen = np.zeros(items.number - first, np.int64)
        for t in sliced(batches, 2 << 20):
            text, _, k, _ = items.hits(folded(t.column("text").combine_chunks()))
            text, k = text[k >= first], k[k >= first] - first
            seen += np.bincount(np.unique(text * max(1, len(seen)) + k) % max(1, len(seen)), minlength=len(seen))[: len(seen)]
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at + first, pa.int64()), pa.array(seen[at], pa.int64())], names=["k", "n"])

    return run


def _search(shared):
    def run(batches):
        items: Items = shared.value
        for t in sliced(batches, 2 << 20):
            w = folded(t.column("text").combine_chunks())
            text, pos, k, h = items.hits(w)
            found = t.column("found").to_pylist()
            edges = np.searchsorted(text, np.arange(t.num_rows + 1))
            if items.tiny:
                for d in np.flatnonzero((w.count > 0) & (w.count < LONG)):
                    ids = items.tiny.get(h[w.first[d] : w.first[d + 1]].tobytes(), [])
                    found[d] = (found[d] or []) + [{"item_id": i, "score": 1.0, "start": 0, "end": int(w.count[d]), "seeds": 1} for i in ids]
            for d in np.flatnonzero(np.diff(edges)):
                a, b = edges[d], edges[d + 1]
                found[d] = (found[d] or []) + items.found(h[w.first[d] : w.first[d + 1]], pos[a:b], k[a:b])
            yield from t.set_column(t.column_names.index("found"), "found", pa.array(found, _FOUND_ARROW)).to_batches()

    return run


def find_copies(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """texts: any columns and `text` -> all of them and found: the items with a copy in the text (item_id, score, start, end, seeds), best first, of equal scores the least item_id.

    start and end count folded words; score is the alignment's part of the best possible.  A column found of texts is
    replaced.  Null texts, and items that are null or without words, match nothing; of an item's equally good places the first
    is told.  Rows of texts don't depend on each other but for the n-grams' counts, so repeated rows get equal results; rows of
    benchmark with equal item_id count as items of their own unless their texts are equal too.  Empty tables: no rows, or nothing found.  A text is searched
    whole, around its seeds.
    """
    spark = texts.sparkSession
    bench = benchmark.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    limit = RARE * texts.count() + RARE_AT_LEAST if size else 0
    out = texts.withColumn("found", F.expr(f"cast(array() as {_FOUND})"))
    for block in range(blocks if size else 0):
        items = Items(bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect())  # about ITEM_BYTES
        every = texts.select("text").mapInArrow(_frequencies(spark.sparkContext.broadcast(items)), "k long, n long")
        # counts stay in Spark: the driver gets the numbers of those that more documents have than a seed may, as an Arrow column
        frequent = every.groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("k").toArrow()
        items.drop_frequent(frequent.column("k").to_numpy())
        out = out.mapInArrow(_search(spark.sparkContext.broadcast(items)), out.schema)
    best = F.expr("array_sort(found, (a, b) -> case when a.score > b.score then -1 when a.score < b.score then 1 when a.item_id < b.item_id then -1 when a.item_id > b.item_id then 1 else 0 end)")
    return out.withColumn("found", best)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document with whether it has a copy of an item, and of which (the best first)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_copies(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.col("found.item_id").alias("item_ids"), F.transform("found", lambda x: F.round(x["score"], 6)).alias("scores"), F.try_element_at(F.col("found.start"), F.lit(1)).alias("start_word"), F.try_element_at(F.col("found.end"), F.lit(1)).alias("end_word"))
