import hashlib

from tidewake.llm.exact_dedup import build_directory, exact_dedup


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def expected(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in pairs:
        g = groups[t or ""]
        top = max((x for x in g if x is not None), default=None)
        out.append((i, top, len(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "a" * 500), (7, "a" * 500), (None, "b"), (9, "é"), (9, "é"), (10, "a")]


def test_against_brute_force(docs):
    for capacity, depth in ((1 << 20, 16), (64, 2), (1, 1), (40, 6), (200, 12)):
        got = rows(exact_dedup(docs(CASES), capacity=capacity, max_depth=depth))
        assert [(a, b, c, e) for a, b, c, _, e in got] == expected(CASES)
        kept = [(a, e) for a, _, _, k, e in got if k]
        assert len(kept) == len({t or "" for _, t in CASES})  # one row of each text stays
        assert all(a == b for a, b, _, k, _ in got if k)


def test_empty_table_and_clashing_columns(docs, clashing):
    assert exact_dedup(docs(["x"]).limit(0)).count() == 0
    assert rows(exact_dedup(clashing(docs(CASES)))) == rows(exact_dedup(docs(CASES)))


def test_directory_splits_overfull_buckets():
    counts = {p: (1, 10) for p in range(16)}
    buckets = build_directory(counts, 40, 4)
    assert [b["depth"] for b in buckets] == [2] * 4
    assert all(b["size"] <= 40 for b in buckets)
    hot = build_directory({3: (1, 1000), 12: (1, 10)}, 100, 4)
    assert [b["pages"] for b in hot if b["size"]] == [10, 1]
    spans = sorted((b["prefix"] << (4 - b["depth"]), (b["prefix"] + 1) << (4 - b["depth"])) for b in hot)
    assert spans[0][0] == 0 and spans[-1][1] == 16 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_long_texts_and_many_copies(docs):
    long = "w " * 300_000
    cases = [(1, long), (2, long), (3, long + "x")] + [(10 + i, "same") for i in range(200)]
    for capacity in (1 << 25, 1 << 17):
        got = rows(exact_dedup(docs(cases), capacity=capacity))
        assert [(a, b, c, e) for a, b, c, _, e in got] == expected(cases)
