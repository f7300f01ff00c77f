"""Repeated passages: Rabin-Karp hashes of every window of WINDOW words, counted in Spark.

Map: each task hashes all windows of its texts.  Of windows equal within one block of texts only the first goes on (the
others are found already), packed by hash bucket: fingerprint, document, start.  Count: the task that owns a bucket
finds the fingerprints with more than one place; all places but the earliest are found.  Check: windows found in a row whose
earlier places lie in a row too are a segment; the earlier place's document tells a digest of the segment's words, and
the segment counts only if its own words have it.  Merge: overlapping windows merge into maximal intervals to remove.

A fingerprint is as wide as the corpus needs: FINGERPRINT_BITS beyond twice the bits of the number of windows, so that
the chance that any two different windows of the corpus are taken for equal stays under 1 in 2**FINGERPRINT_BITS.  Words
are compared by 128-bit digests before anything is removed, so such a pair removes nothing; at worst a third place, equal
to the later one of the two, is kept.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, table
from .words import Words, mixed, sliced

WINDOW = 20
FINGERPRINT_BITS = 6
#: Windows of a bucket, bytes of the texts of a merge task, bytes of the texts of a map block.
BUCKET, CHUNK, BLOCK = 2_000_000, 8 << 20, 3 << 20
#: Blocks and buckets grow together, up to GROWTH times, from STEADY buckets on, so that a block has several windows for each bucket.
STEADY, GROWTH = 4_000, 16
#: Fewest bytes of a fingerprint; ids below NULL_IDS stand for null.
LEAST_BYTES, NULL_IDS = 4, -(2**62)


def _odd(n: float) -> int:
    return max(1, math.ceil(n)) | 1


def pack(x: np.ndarray) -> bytes:
    """Non-decreasing or arbitrary int64 values: differences, in byte planes, deflated but for the lowest."""
    d = np.diff(x, prepend=np.int64(0)).view(np.uint64)
    d = (d << np.uint64(1)) ^ (np.uint64(0) - (d >> np.uint64(63)))  # zigzag
    planes = d.view(np.uint8).reshape(-1, 8)
    return zlib.compress(planes[:, 1:].T.tobytes(), 1) + planes[:, 0].tobytes()


def unpack(b: bytes, n: int) -> np.ndarray:
    planes = np.empty((n, 8), np.uint8)
    planes[:, 0] = np.frombuffer(b, np.uint8)[len(b) - n :]
    planes[:, 1:] = np.frombuffer(zlib.decompress(b[: len(b) - n]), np.uint8).reshape(7, n).T
    d = planes.reshape(-1).view(np.uint64)
    return np.cumsum(((d >> np.uint64(1)) ^ (np.uint64(0) - (d & np.uint64(1)))).view(np.int64))


def _fingerprints(h: np.ndarray, h2: np.ndarray | None, width: int) -> np.ndarray:
    """Rows of `width` bytes."""
    low = h.view(np.uint8).reshape(-1, 8)
    if width <= 8:
        return low[:, :width]
    return np.concatenate([low, h2.view(np.uint8).reshape(-1, 8)[:, : width - 8]], axis=1)


def _keys(fp: np.ndarray) -> list[np.ndarray]:
    out = []
    for at in range(0, fp.shape[1], 8):
        part = np.zeros((len(fp), 8), np.uint8)
        part[:, : min(8, fp.shape[1] - at)] = fp[:, at : at + 8]
        out.append(part.reshape(-1).view(np.uint64))
    return out


def _later(keys: list[np.ndarray], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places with equal keys: indices of those after the earliest, and of the earliest for each; indices of the earliest (of each key that has several) and of all single ones."""
    order = np.argsort(keys[0], kind="stable")
    k = keys[0][order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    many = same[:-1] | same[1:]
    alone, rest = order[~many], order[many]
    rest = rest[np.lexsort((start[rest], doc[rest], *[x[rest] for x in keys[::-1]]))]
    new = np.ones(len(rest), bool)
    if len(rest):
        new[1:] = np.any([x[rest][1:] != x[rest][:-1] for x in keys], axis=0)
    lead = rest[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(rest) else rest
    later = (doc[rest] != doc[lead]) | (start[rest] != start[lead])
    return rest[later], lead[later], np.concatenate([alone, rest[new]])


#: kind 0: windows of a bucket (key); 1: places found (of documents of a chunk, the key) and their earlier places.
_PACKED = "kind int, key long, n int, docs binary, starts binary, prints binary, leads binary, lead_starts binary"
_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("docs", "starts", "prints", "leads", "lead_starts")]])
_NAMES = _ARROW.names


def _by_chunk(doc: np.ndarray, chunks: int, *within: np.ndarray):
    """(chunk, indices) of the documents of each chunk, by document and then by `within`."""
    key = np.mod(doc, chunks)
    order = np.lexsort((*within[::-1], doc, key))
    key = key[order]
    edges = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(key[a]), order[a:b]


def _places(doc: np.ndarray, start: np.ndarray, later: np.ndarray, lead: np.ndarray, chunks: int):
    long = start.astype(np.int64)
    for chunk, at in _by_chunk(doc[later], chunks, start[later]):
        own, other = later[at], lead[at]
        yield (1, chunk, len(at), pack(doc[own]), pack(long[own]), None, pack(doc[other]), pack(long[other]))


def _rows(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def _map(window: int, width: int, block: int, buckets: int, chunks: int):
    def run(batches):
        for t in sliced(batches, block):
            t = t.sort_by("doc_id") if t.num_rows > 1 else t
            ids = np.asarray(t.column("doc_id").combine_chunks(), np.int64)
            w = Words(t.column("text"))
            h = w.hashes()
            if len(h) < window:
                continue
            doc_of = np.repeat(np.arange(len(ids)), w.count)
            start = (np.arange(len(h)) - np.repeat(w.first[:-1], w.count)).astype(np.int32)
            ok = np.flatnonzero(doc_of[: len(h) - window + 1] == doc_of[window - 1 :])
            doc, start = ids[doc_of[ok]], start[ok]
            del doc_of
            a = w.windows(h, window)[ok]
            b = w.windows(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), window, 0xE7037ED1A0B428DB)[ok] if width > 8 else None
            del h, w
            fp = _fingerprints(a, b, width)
            later, lead, firsts = _later(_keys(fp), doc, start)
            if len(later):
                yield _rows(_places(doc, start, later, lead, chunks))
            home = (a[firsts] & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            order = np.lexsort((firsts, home))
            home, firsts = home[order], firsts[order]
            edges = np.searchsorted(home, np.arange(buckets + 1, dtype=np.uint64))
            out = []
            for k in np.flatnonzero(np.diff(edges)):
                at = firsts[edges[k] : edges[k + 1]]
                out.append((0, int(k), len(at), pack(doc[at]), pack(start[at].astype(np.int64)), fp[at].tobytes(), None, None))
            yield _rows(out)

    return run


def _count(width: int, chunks: int):
    def run(t: pa.Table) -> pa.Table:
        if t.column("kind")[0].as_py() == 1:
            return t
        doc, start, fp = [], [], []
        for n, d, s, p in zip(*(t.column(c).to_pylist() for c in ("n", "docs", "starts", "prints")), strict=True):
            doc.append(unpack(d, n))
            start.append(unpack(s, n).astype(np.int32))
            fp.append(np.frombuffer(p, np.uint8).reshape(n, width))
        doc, start, fp = np.concatenate(doc), np.concatenate(start), np.concatenate(fp)
        later, lead, _ = _later(_keys(fp), doc, start)
        return pa.Table.from_batches([_rows(_places(doc, start, later, lead, chunks))])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _column(t: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(unpack(b, k) for b, k in zip(t.column(name).to_pylist(), t.column("n").to_pylist(), strict=True))])


#: Segments of windows in a row: asked of the chunk of the earlier place's document (chunk), for a document of chunk `own`.
_SEGMENTS = "chunk long, own long, n int, docs binary, starts binary, sizes binary, leads binary, lead_starts binary, digests binary"
_SEGMENTS_ARROW = pa.schema([("chunk", pa.int64()), ("own", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("docs", "starts", "sizes", "leads", "lead_starts", "digests")]])


def _segment_rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_SEGMENTS_ARROW)
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _SEGMENTS_ARROW, strict=True)], schema=_SEGMENTS_ARROW)


def _segments(chunks: int):
    """Places found in a chunk -> segments, by chunk of the earlier place's document."""

    def run(t: pa.Table) -> pa.Table:
        own = t.column("key")[0].as_py()
        doc, start, lead, at = (_column(t, c) for c in ("docs", "starts", "leads", "lead_starts"))
        order = np.lexsort((at, lead, start, doc))
        doc, start, lead, at = doc[order], start[order], lead[order], at[order]
        row = (np.diff(doc) == 0) & (np.diff(start) == 1) & (np.diff(lead) == 0) & (np.diff(at) == 1)
        first = np.flatnonzero(np.append(True, ~row))
        size = np.diff(np.append(first, len(doc)))
        doc, start, lead, at, out = doc[first], start[first], lead[first], at[first], []
        for chunk, k in _by_chunk(lead, chunks, at):
            out.append((chunk, own, len(k), pack(doc[k]), pack(start[k]), pack(size[k]), pack(lead[k]), pack(at[k]), None))
        return _segment_rows(out)

    return run


def _digest(words: list[bytes], start: int, end: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start:end]), digest_size=16).digest()


def _answers(window: int):
    """Segments asked of a chunk, and its documents -> the same with digests of the words at the earlier places."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        lead, at, size = (_column(asked, c) for c in ("leads", "lead_starts", "sizes"))
        digest, last, known = [b""] * len(lead), None, b""
        order = np.lexsort((size, at, lead))
        text_of = dict.fromkeys(np.unique(lead).tolist())
        for i, text in zip(docs.column("doc_id").to_pylist(), docs.column("text"), strict=True):
            if i in text_of:
                text_of[i] = [*(text_of[i] or []), (text.as_py() or "").encode()]
        words_of, words = None, []
        for k in order:
            place = (int(lead[k]), int(at[k]), int(size[k]))
            if place != last:
                if place[0] != words_of:
                    words_of, words = place[0], [x.split() for x in text_of[place[0]] or []]
                end = place[1] + place[2] + window - 1
                known, last = b"".join(_digest(x, place[1], end) for x in words[:1] or [[]]), place
                for x in words[1:]:  # several rows of one id: the digest of one that is long enough
                    known = _digest(x, place[1], end) if len(x) >= end and len(words[0]) < end else known
            digest[k] = known
        out, done = [], 0
        for row in asked.to_pylist():
            out.append((row["own"], None, row["n"], row["docs"], row["starts"], row["sizes"], None, None, b"".join(digest[done : done + row["n"]])))
            done += row["n"]
        return _segment_rows(out)

    return run


def _merge(window: int, with_text: bool):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        doc, start, size = (_column(found, c) for c in ("docs", "starts", "sizes"))
        digest = b"".join(found.column("digests").to_pylist())
        order = np.lexsort((start, doc))
        doc, start, size = doc[order], start[order], size[order]
        rows = []
        for i, text in zip(docs.column("doc_id").to_pylist(), docs.column("text"), strict=True):
            words = (text.as_py() or "").encode().split()
            runs: list[dict] = []
            for k in range(int(np.searchsorted(doc, i)), int(np.searchsorted(doc, i, "right"))):
                a, b = int(start[k]), int(start[k] + size[k]) + window - 1
                if b <= len(words) and _digest(words, a, b) == digest[16 * order[k] : 16 * order[k] + 16]:
                    if runs and a <= runs[-1]["end"]:
                        runs[-1]["end"] = max(b, runs[-1]["end"])
                    else:
                        runs.append({"start": a, "end": b})
            kept, at = [], 0
            for r in runs:
                kept += words[at : r["start"]]
                at = r["end"]
            kept = b" ".join(kept + words[at:])
            rows.append((None if i < NULL_IDS else i, len(words), sum(r["end"] - r["start"] for r in runs), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, runs))
        cols = list(zip(*rows, strict=True)) or [[]] * len(_OUT)
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _OUT, strict=True)], schema=_OUT)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless with_text), removed (maximal word intervals, end exclusive).

    A word goes if a window that covers it has its words also at an earlier place: in a row of smaller doc_id, or earlier
    in the same text.  Windows are judged on the input.  A null text has no words; a null id comes before all others, and rows
    with null ids are told apart by a hash of their text, in the order of these hashes.  Rows of one id are taken as one
    document: places equal in id and start don't count against each other, and what is found in one row of the id holds for
    its rows with the same words there.  Ids below -2**62 are read as null.  Other columns aren't looked at.  An empty table
    gives no rows.  A text is never cut: a task holds the longest one, split into words.
    """
    of_null = F.lit(2 * NULL_IDS) + F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).bitwiseAND(F.lit(2**62 - 1))
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), of_null).alias("doc_id"), docs[text_col].alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = size / 6 + 1
    width = max(LEAST_BYTES, math.ceil((2 * math.log2(size + 2) - 3 + FINGERPRINT_BITS) / 8))  # two bytes a word at least; pairs are half the square
    larger = min(GROWTH, max(1.0, math.sqrt(windows / BUCKET / STEADY)))
    buckets, chunks = max(1, math.ceil(windows / BUCKET / larger)), _odd(size / CHUNK)
    packed = rows.mapInArrow(_map(window, width, int(BLOCK * larger), buckets, chunks), _PACKED)
    found = packed.groupBy("kind", "key").applyInArrow(_count(width, chunks), _PACKED)
    asked = found.where("kind = 1").groupBy("key").applyInArrow(_segments(chunks), _SEGMENTS)
    texts = rows.select(F.expr(f"pmod(doc_id, {chunks}L)").alias("chunk"), "doc_id", "text").groupBy("chunk")  # one exchange for both uses
    answers = texts.cogroup(asked.groupBy("chunk")).applyInArrow(_answers(window), _SEGMENTS)
    merged = texts.cogroup(answers.groupBy("chunk"))
    return merged.applyInArrow(_merge(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<start:int,end:int>>")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d)),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
