"""Near-dedup, substring dedup, decontamination, line dedup and components against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cases import awkward_rows, documents, prose
from quarrystone.llm import decontam, graph, line_dedup, near_dedup, shared, substring_dedup


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_classes(rows, n, percent):
    sets = defaultdict(list)
    for i, text in rows:
        sets[i].append(shingles(text, n))
    ids = sorted(i for i in sets if i is not None)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {i: root(i) for i in ids}


def chained(seed, copies):
    """Copies of copies: similar to their parent, less and less to the first."""
    r = random.Random(seed)
    texts = [prose(seed, 120).split()]
    for _ in range(copies):
        words = list(r.choice(texts))
        for _ in range(r.choice((0, 1, 2, 3))):
            words[r.randrange(len(words))] = f"z{r.randrange(10_000)}"
        texts.append(words)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_the_brute_force_classes(spark, size, percent):
    texts = chained(5, 90) + chained(6, 40) + [prose(100 + i, 50) for i in range(30)]
    rows = awkward_rows() + list(enumerate(texts, 100))
    want = brute_classes(rows, size, percent)
    got = near_dedup.near_duplicates(documents(spark, rows), size, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    counts = {i: len(shingles(t, size)) for i, t in rows if i is not None}
    assert all(r["n_shingles"] == counts[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)
    rows = list(enumerate(chained(9, 120)))
    want = brute_classes(rows, 3, 85)
    got = near_dedup.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_a_group_of_several_chunks_moves_linearly_many_rows(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)
    monkeypatch.setattr(near_dedup, "PIVOTS", 4)
    moved, plain = [], near_dedup.compared
    monkeypatch.setattr(near_dedup, "compared", lambda rows, *a, **k: moved.append(rows.count()) or plain(rows, *a, **k))
    base = prose(31, 100).split()
    counts = {}
    for n in (100, 400):
        moved.clear()
        rows = [(i, " ".join([*base[: i % 90], f"z{i}", *base[i % 90 + 1 :]])) for i in range(n)]
        got = near_dedup.near_duplicates(documents(spark, rows), 3, 85).collect()
        assert {r["component_id"] for r in got} == {0}
        counts[n] = sum(moved[-3:])  # the rows of the exact check
    assert counts[400] <= 5 * counts[100] and counts[400] <= 400 * 4


def test_a_group_that_hangs_together_by_chains_moves_linearly_many_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)
    monkeypatch.setattr(near_dedup, "PIVOTS", 4)
    moved, plain = [], near_dedup.compared
    monkeypatch.setattr(near_dedup, "compared", lambda rows, *a, **k: moved.append(rows.count() if "text" in rows.columns else 0) or plain(rows, *a, **k))
    base, counts = prose(32, 2000).split(), {}
    for n in (64, 256):
        moved.clear()
        rows = [(i, " ".join(base[6 * i : 6 * i + 120])) for i in range(n)]  # each is near the next two only
        got = near_dedup.near_duplicates(documents(spark, rows), 3, 85).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == brute_classes(rows, 3, 85) == dict.fromkeys(range(n), 0)
        counts[n] = sum(moved)
    assert counts[256] <= 5 * counts[64] and counts[256] <= 256 * 8


def test_a_group_of_many_pairs_just_below_the_threshold_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)
    monkeypatch.setattr(near_dedup, "PIVOTS", 4)
    moved, plain = [], near_dedup.compared
    monkeypatch.setattr(near_dedup, "compared", lambda rows, *a, **k: moved.append(rows.count() if "text" in rows.columns else 0) or plain(rows, *a, **k))
    base, r, n = prose(33, 300).split(), random.Random(33), 128
    rows = []
    for i in range(n):
        words = list(base)
        for at in r.sample(range(300), r.choice((4, 9, 10, 11, 12))):
            words[at] = f"z{i}x{at}"
        rows.append((i, " ".join(words)))
    want = brute_classes(rows, 3, 85)
    got = near_dedup.near_duplicates(documents(spark, rows), 3, 85).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want and 1 < len(set(want.values())) < n
    assert sum(moved) <= n * (n // 8) + n * (n // 16) + 2 * n  # all in blocks, and the pivots; pairs would be n * n / 2


def test_links_of_texts_that_share_a_doc_id(spark, monkeypatch):
    a, b, c = prose(71, 80), prose(72, 80), prose(73, 80)
    near = lambda t, k: t.replace(t.split()[40], f"other{k}", 1)
    d, e, f, g, h = (prose(74 + i, 80) for i in range(5))
    rows = [(10, a), (10, b), (11, near(a, 1)), (12, near(b, 2))]
    rows += [(21, d), (30, d), (30, e), (32, e)]
    rows += [(45, f), (45, g), (46, h), (46, near(g, 3)), (47, ""), (47, near(h, 4)), (47, near(h, 4)), (48, None), (None, a), (49, c), (49, c)]
    want = brute_classes(rows, 3, 85)
    for block in (1024, 2):
        monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
        monkeypatch.setattr(shared, "HOT_KEYS", 100_000 if block > 2 else 1)
        got = near_dedup.near_duplicates(documents(spark, rows), 3, 85).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted((i, want[i]) for i, _ in rows if i is not None)


def test_near_duplicates_without_broadcast_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    rows = list(enumerate(chained(4, 20)))
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(documents(spark, rows), 3, 85).collect()} == brute_classes(rows, 3, 85)
    assert near_dedup.near_duplicates(documents(spark, []), 3, 85).count() == 0


def test_one_of_each_class_stays(spark):
    docs = documents(spark, list(enumerate(chained(4, 20))))
    left = near_dedup.drop_near_duplicates(docs, 5, 80)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == set(brute_classes(list(enumerate(chained(4, 20))), 5, 80).values())


def test_bayesian_table_keeps_what_reaches_the_threshold():
    tests = near_dedup.least_matches(85, 120)
    assert [n for n, _ in tests] == [24, 48, 72, 96, 120]
    assert all(m < 0.85 * n for n, m in tests) and tests[-1][1] > 0.6 * 120


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 202), (202, 200)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {i: 200 for i in (200, 201, 202)}
    assert graph.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_removed(rows, k=13):
    """(n_words, n_removed, digest) of each row, in their order."""
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for at in range(len(w) - k + 1):
            key = tuple(w[at : at + k])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for at in range(len(w) - k + 1):
            if i is not None and first[tuple(w[at : at + k])] < i:
                gone[at : at + k] = [True] * k
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def check_removed(spark, rows):
    got = substring_dedup.remove_repeated(documents(spark, rows)).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute_removed(rows), strict=True)]
    assert sorted(map(str, [tuple(r)[:4] for r in got])) == sorted(map(str, want))


@pytest.mark.parametrize(("bits", "block", "hot_keys", "rows"), [(1 << 28, 10, 100_000, 500_000), (0, 4, 3, 0)])
def test_repeated_substrings_are_removed(spark, monkeypatch, bits, block, hot_keys, rows):
    for name, value in (("BITMAP_BITS", bits), ("BLOCK_BITS", block), ("BROADCAST_ROWS", rows)):
        monkeypatch.setattr(substring_dedup, name, value)
    if hot_keys == 3:
        monkeypatch.setattr(shared, "HOT_ROWS", 5)
        monkeypatch.setattr(shared, "HOT_KEYS", hot_keys)
    passage = prose(77, 60)
    rows = awkward_rows() + [(100 + i, f"{prose(200 + i, 40)} {passage} {prose(300 + i, 40)}") for i in range(12)] + [(150, passage + " " + passage), (151, prose(400, 13)), (152, prose(400, 13)), (153, prose(401, 12)), (154, prose(401, 12))]
    # Branches, loops and places where paths meet.
    a, b, c = (prose(500 + i, 30) for i in range(3))
    rows += [(160, f"{a} {b} {c}"), (161, f"{a} {c} {b}"), (162, f"{b} {a} {b} {a} {b}"), (163, f"x {a} {b} y"), (164, f"{a} {b}"), (165, ("tick tock " * 40).strip()), (166, ("tick tock " * 25).strip()), (167, c + " z"), (168, "z " + c)]
    check_removed(spark, rows)
    assert substring_dedup.remove_repeated(documents(spark, [])).count() == 0


def test_repeated_substrings_of_mixed_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BITS", 3)
    r = random.Random(1)
    parts = [prose(900 + i, r.randint(5, 40)) for i in range(14)]
    check_removed(spark, [(i, " ".join(r.choice(parts) for _ in range(r.randint(1, 8)))) for i in range(120)])


def test_texts_that_share_a_doc_id(spark):
    a, b, c = prose(61, 50), prose(62, 50), prose(63, 40)
    rows = [(1, f"{a} {b}"), (2, f"{c} {a}"), (2, b), (3, f"{b} {c}"), (3, prose(64, 40)), (3, f"{b} {c}"), (4, f"{prose(65, 9)} {c}"), (4, f"{prose(66, 9)} {c}"), (5, f"{a} {b}"), (5, f"{a} new"), (6, f"{a} {b}"), (6, f"{a} {b}"), (7, c), (7, c)]
    d, e = prose(69, 50), prose(70, 50)
    rows += [(11, d), (11, e), (12, d), (12, prose(67, 30)), (12, prose(68, 10) + " " + e)]
    check_removed(spark, rows)


def test_spans_with_other_words_than_their_source_stay(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "span_digest", lambda words, start, end: bytes([start % 251]) * 16)
    rows = [(1, prose(1, 40)), (2, "one two three " + prose(1, 40))]
    assert [r["n_removed"] for r in substring_dedup.remove_repeated(documents(spark, rows)).orderBy("doc_id").collect()] == [0, 0]


def brute_contained(rows, items, n=5, percent=80):
    docs = defaultdict(set)
    for i, text in rows:
        docs[i] |= shingles(text, n)
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= shingles(text, n)
    return {(d, i): (len(s & q), len(q)) for d, s in docs.items() for i, q in asked.items() if d is not None and i is not None and q and 100 * len(s & q) >= percent * len(q)}


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_contained_items_are_found(spark, monkeypatch, rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    items = [(i, prose(500 + i, 8 + 5 * i)) for i in range(25)] + [(50, None), (51, ""), (52, "one"), (53, "four words are here"), (None, prose(1, 60)), (54, prose(1, 60)), (54, prose(1, 60))]
    docs = awkward_rows()
    for i in range(25):
        w = items[i][1].split()
        docs.append((200 + i, f"{prose(600 + i, 300)} {items[i][1]} {prose(700 + i, 300)}"))
        docs.append((300 + i, f"{prose(800 + i, 50)} {' '.join(w[: max(1, len(w) * 17 // 20)])} {prose(900 + i, 10)}"))
    docs.append((400, " ".join(t or "" for _, t in items)))  # one document holds them all
    want = brute_contained(docs, items)
    got = decontam.contained_items(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item_shingles"]) for r in got} == want
    assert len(got) == len(want)


def test_a_shingle_that_all_share_pairs_nothing_by_itself(spark, monkeypatch):
    common = "this is the common notice of all texts"
    items = [(i, f"{common} {prose(1100 + i, 40)}") for i in range(20)]
    docs = [(i, f"{prose(1200 + i, 30)} {common} " + " ".join(" ".join(items[k % 20][1].split()[8:30]) for k in range(i, i + 9))) for i in range(60)]
    docs += [(100 + i, f"{prose(1300 + i, 40)} {items[i][1]} {prose(1400 + i, 40)}") for i in range(20)]
    seen, plain = [], decontam.candidate_pairs
    monkeypatch.setattr(decontam, "candidate_pairs", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = decontam.contained_items(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(brute_contained(docs, items)) >= {(100 + i, i) for i in range(20)}
    # All 80 x 20 pairs share the notice; the search pairs only those with rare shingles in common.
    assert seen[0].count() <= 60 * 9 + 20 < 80 * 20


def test_decontamination_of_nothing_drops_nothing(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contained_items(docs, none).count() == 0
    assert decontam.contained_items(documents(spark, []), spark.createDataFrame([(1, "a b c d e")], "item_id bigint, text string")).count() == 0
    assert decontam.drop_contaminated(docs, none).count() == docs.count()
    left = decontam.drop_contaminated(docs, spark.createDataFrame([(1, prose(1, 60))], "item_id bigint, text string"))
    assert left.columns == docs.columns and 1 not in [r["doc_id"] for r in left.select("doc_id").collect()]


def test_lines_of_recurring_templates_go(spark):
    notice = "Printed copy number {} of this internal report today"
    rows = [(i, f"{prose(i, 20)}\n{notice.format(i * 37)}\n{prose(1000 + i, 15)}") for i in range(12)]
    rows += [(20, "only here 5 times\n" * 5), (21, None), (22, ""), (23, "\n\n"), (None, notice.format(3)), (24, notice.format(9)), (24, notice.format(9))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_lines", F.lit("clash"))
    got = defaultdict(list)
    for r in line_dedup.dedup_lines(docs).collect():
        got[r["doc_id"]].append((r["n_lines"], r["n_dropped"], r["text"]))
    assert got[0] == [(3, 0, rows[0][1])]  # the first keeps its line
    for i in range(1, 12):
        assert got[i] == [(3, 1, rows[i][1].replace("\n" + notice.format(i * 37), ""))]
    assert got[20][0][1] == 0 and got[21] == [(0, 0, None)] and got[22] == [(1, 0, "")] and got[23] == [(3, 0, "\n\n")]
    assert got[24] == [(1, 1, ""), (1, 1, "")] and got[None] == [(1, 0, notice.format(3))]
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_columns_of_any_name_are_kept(spark):
    notice = "Printed copy number 7 of this internal report today"
    names = ["whole", "kept_lines", "drop_keys", "drop_doc", "left_text", "own_0", "leaf", "form_key", "n_lines", "n_dropped", "a.b", "n_chars"]
    rows = [(i, f"{prose(i, 20)}\n{notice}", *range(len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    for r in line_dedup.dedup_lines(docs).collect():
        assert (r["n_lines"], r["n_dropped"]) == (2, int(r["doc_id"] > 0))
        assert [r[n] for n in names if n not in ("n_lines", "n_dropped")] == [k for k, n in enumerate(names) if n not in ("n_lines", "n_dropped")]
    left = line_dedup.strip_lines(docs)
    assert left.schema == docs.schema
    for r in left.collect():
        assert r["n_lines"] == names.index("n_lines") and r["whole"] == 0
        assert r["n_chars"] == (len(r["text"]) if r["doc_id"] else names.index("n_chars"))


def test_variable_fields_without_digits_are_generalised(spark):
    rows = [(i, f"Report written by the author {w} for internal use only") for i, w in enumerate(prose(3, 14).replace("w", "name").translate(str.maketrans("0123456789", "abcdefghij")).split())]
    dropped = sum(r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert dropped == len(rows) - 1


def test_prose_that_only_begins_alike_stays(spark):
    rows = [(i, "In the beginning " + prose(40 + i, 12).translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(40)]
    assert sum(r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == 0
