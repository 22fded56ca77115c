"""What is kept and maintained: pointers and leases, segmented indexes, cells, logs, stores, exports, embeddings, structure, differences."""

import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone import store
from quarrystone.functions import docx, embedding_store, html, lines, models
from quarrystone.operators import bm25, cells, chunking, dense, fusion, lookup, quality_reports, segments
from quarrystone.plans import reindex as reindexing
from quarrystone.plans.reindex import exclusive_reindex, reindex, sparse_index
from quarrystone.sources import event_log, export, pages
from quarrystone.streaming import streams


def test_documents_of_negative_score_rank_behind_those_without(spark):
    corpus = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a a"), (3, "")], "id bigint, text string").withColumn("ord", F.col("id"))
    queries = spark.createDataFrame([(1, "a")], "query_id bigint, text string")
    whole = bm25.bm25_topk(corpus, queries, 9, "id", "ord").orderBy("rank").collect()
    assert [r["score"] < 0 for r in whole] == [False, True, True, True] and whole[0]["id"] == 3
    for pool in (1, 2, 3, 4):
        got = bm25.bm25_topk(corpus, queries, pool, "id", "ord").orderBy("rank").collect()
        assert [(r["id"], r["score"]) for r in got] == [(r["id"], r["score"]) for r in whole[:pool]]
    same = spark.createDataFrame([(i, "a") for i in range(3)], "id bigint, text string").withColumn("ord", F.col("id"))
    assert bm25.bm25_topk(same, queries, 1, "id", "ord").first()["score"] < 0  # no document is without the term


def test_no_publication_is_lost(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/x"
    assert store.publish(spark, root, "one") == 1
    real, late = store.last, [0, 0]
    monkeypatch.setattr(store, "last", lambda *a: late.pop() if late else real(*a))
    assert store.publish(spark, root, "two") == 2  # it looked before "one" was there
    monkeypatch.setattr(store, "last", real)
    assert store.current(spark, root) == "two" and (tmp_path / "x/pointers/000000000001").read_text() == "one"
    with pytest.raises(store.Conflict):
        store.publish(spark, root, "three", after=1)
    assert store.publish(spark, root, "three", after=2) == 3 and store.current(spark, root) == "three"
    assert not store.claim(spark, f"{root}/pointers/{3:012d}", "again") and store.current(spark, root) == "three"


def test_one_job_holds_the_lease(spark, tmp_path):
    root = f"file://{tmp_path}/x"
    first = store.Lease.acquire(spark, root, "first", 60, now=100)
    with pytest.raises(store.Busy, match="first is active"):
        store.Lease.acquire(spark, root, "second", 60, now=150)
    first = first.renewed(spark, 60, now=150)
    with pytest.raises(store.Busy):
        store.Lease.acquire(spark, root, "second", 60, now=200)
    second = store.Lease.acquire(spark, root, "second", 60, now=211)  # its time is over
    assert second.number > first.number
    with pytest.raises(store.Busy):
        first.renewed(spark, 60, now=212)
    first.release(spark)  # lost: nothing happens
    with pytest.raises(store.Busy):
        store.Lease.acquire(spark, root, "third", 60, now=213)
    second.release(spark)
    assert store.Lease.acquire(spark, root, "third", 60, now=214).number > second.number


def test_deep_and_broken_pages_stop_nothing(spark):
    deep = "<div>" * 3000 + "<a href='/x'>in <s>old</s></a>" + "</div>" * 3000
    rows = [(1, "http://a.x/", deep), (2, "http://a.x/b", "<p>" + "word " * 60 + "</p><![x"), (3, "http://a.x/c", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {(r["page_id"], r["target"]) for r in pages.links(df).collect()} == {(1, "http://a.x/x")}
    assert {r["page_id"]: r["text"] for r in pages.extract_pages(df).collect()}[1] == "in [obsolete: old]"
    assert pages.page_chunks(df).count() >= 0 and pages.preview(df).count() == 3
    assert html.text_of(html.parse("<p>a <del>b <s>c</s> d</del> e</p>")) == "a [obsolete: b c d] e"
    assert pages.clean_article("<body><div class='ad x'>buy</div><p>text</p></body>") == "text"


WORDS = [f"w{i}" for i in range(60)]


def corpus_rows(seed, n, prefix):
    r = random.Random(seed)
    return [(f"{prefix}{i:04}", " ".join(r.choices(WORDS, weights=range(1, 61), k=r.randint(0, 30)))) for i in range(n)]


def plain_ranking(spark, rows, queries, pool):
    corpus = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "key string, text string, ord bigint")
    found = bm25.bm25_topk(corpus, queries, pool, "key", "ord").collect()
    return sorted((r["query_id"], r["rank"], r["key"], round(r["score"], 9)) for r in found)


def segment_ranking(spark, listing, queries, pool):
    found = bm25.search(segments.index(spark, listing), queries, pool).collect()
    return sorted((r["query_id"], r["rank"], r["key"], round(r["score"], 9)) for r in found)


def test_segments_follow_the_corpus(spark, tmp_path):
    root = f"file://{tmp_path}/segments"
    queries = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=4))) for i in range(5)] + [(9, "")], "query_id bigint, text string")
    rows = corpus_rows(1, 300, "a")
    frame = lambda some: spark.createDataFrame(some, "key string, text string").withColumn("at", F.col("key"))
    listing = segments.increment(spark, root, segments.empty_listing(), None, frame(rows), ["at"])
    assert segment_ranking(spark, listing, queries, 12) == plain_ranking(spark, rows, queries, 12)
    whole = listing["segments"][0]["postings"]
    for step in range(6):
        gone = {k for k, _ in rows[step::97]} | ({rows[-1][0]} if step else set())
        again = [(k, "w1 again " + t) for k, t in rows if k in gone][:1]
        new = sorted(corpus_rows(10 + step, 3, f"b{step}") + again)
        before = {s["folder"] for s in listing["segments"]}
        listing = segments.increment(spark, root, listing, frame([(k, "") for k in gone]).select("key"), frame(new), ["at"])
        rows = [(k, t) for k, t in rows if k not in gone] + new
        assert segment_ranking(spark, listing, queries, 12) == plain_ranking(spark, rows, queries, 12)
        if step == 0:
            assert sum(s["postings"] for s in listing["segments"] if s["folder"] not in before) < 0.05 * whole
    assert len(listing["segments"]) < 6  # small ones were merged
    assert {r["term"]: r["df"] for r in segments.index(spark, listing).terms.collect()} == Counter(w for _, t in rows for w in set(t.split()))
    none = segments.increment(spark, root, listing, frame(rows).select("key"), frame(rows).limit(0), ["at"])
    assert none["segments"] == [] and segment_ranking(spark, none, queries, 3) == []


def test_a_segment_moves_texts_not_counted_words(spark, tmp_path, monkeypatch):
    plans, plain = [], bm25.write_bucketed
    monkeypatch.setattr(bm25, "write_bucketed", lambda docs, *a: plans.append(docs._jdf.queryExecution().optimizedPlan().toString()) or plain(docs, *a))
    monkeypatch.setattr(bm25, "BUCKET_POSTINGS", 20)
    frame = lambda rows: spark.createDataFrame(rows, "key string, text string, at int, nth int")
    made = lambda rows: segments.index(spark, segments.increment(spark, f"file://{tmp_path}/s", segments.empty_listing(), None, frame(rows), ["at", "nth"]))
    rows = [(f"k{i}", " ".join(random.Random(i).choices(WORDS, k=i % 9)), -i // 3, i) for i in range(120)] + [("none", None, 7, 0)]
    index = made(rows)
    assert len(plans) == 1 and plans[0].index("regexp_extract_all") < plans[0].index("RepartitionByExpression")  # dealt, then counted
    want = {(k, w): n for k, t, *_ in rows for w, n in Counter((t or "").split()).items()}
    assert {(r["key"], r["term"]): r["tf"] for r in index.postings.collect()} == want and index.size.first()["n_docs"] == 121
    assert [r["key"] for r in index.docs.orderBy("ord").collect()] == [k for k, *_ in sorted(rows, key=lambda r: r[2:])]
    again = made([("a", "x y", 3, 0), ("b", "y", 2, 0), ("a", "y z", 1, 0), (None, "w", 0, 0)])  # rows of one key are one document
    assert [r["key"] for r in again.docs.orderBy("ord").collect()] == [None, "a", "b"]
    assert {r["term"]: r["df"] for r in again.terms.collect()} == {"x": 1, "y": 2, "z": 1, "w": 1} and {(r["key"], r["term"]): r["tf"] for r in again.postings.collect()}["a", "y"] == 2


def test_what_only_chunks_need_is_in_no_manifest(spark, tmp_path, monkeypatch):
    root, plans = f"file://{tmp_path}/index", []
    monkeypatch.setattr(reindexing, "BROADCAST_PATHS", 1)
    chunk = lambda files: plans.append(files._jdf.queryExecution().optimizedPlan().toString()) or chunked(files)
    for texts in ({"a": "red fox\nblue bird", "b": "green frog", "d": "last"}, {"a": "red fox", "c": "blue whale\nred kite", "d": "last"}):
        done = reindex(spark, root, snapshot(spark, texts), chunk, models.HashEmbedder(8), body=("text",))
        assert "text" not in spark.read.parquet(f"{done.version}/manifest").columns
    assert "Join" not in plans[0] and len(plans) == 2  # texts are not looked up by path
    rows = {(r["chunk_id"], r["text"]) for r in spark.read.parquet(f"{done.version}/chunks").collect()}
    assert rows == {("a_0", "red fox"), ("c_0", "blue whale"), ("c_1", "red kite"), ("d_0", "last")}
    assert {r["chunk_id"] for r in spark.read.parquet(f"{done.version}/vectors").collect()} == {k for k, _ in rows}


def test_scores_are_summed_where_postings_lie(spark, tmp_path):
    corpus = spark.createDataFrame([(i % 7, i, f"w{i % 3} w{i % 5} both") for i in range(60)], "doc bigint, chunk bigint, text string")
    queries = spark.createDataFrame([(1, "w1 both"), (2, "w4")], "query_id bigint, text string")
    index = bm25.write_index(corpus, "chunk", "chunk", f"file://{tmp_path}/index", home=("doc",))
    scores = bm25.bm25_scores(index, queries)
    per_doc = scores.groupBy("query_id", "doc").agg(F.max("score").alias("score"))
    plan = per_doc._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+L?, doc#", plan) and "term IN" in plan.replace("In(term", "term IN")
    plain = bm25.bm25_topk(corpus, queries, 60, "chunk", "chunk", zero_fill=False).collect()
    assert sorted((r["query_id"], r["chunk"], round(r["score"], 9)) for r in scores.collect()) == sorted((r["query_id"], r["chunk"], round(r["score"], 9)) for r in plain)


def snapshot(spark, texts):
    return spark.createDataFrame([(p, len(t), 1, str(hash(t)), t) for p, t in texts.items()], "path string, size_bytes int, mtime int, sha256 string, text string")


def chunked(files):
    return files.select("path", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")).withColumn("chunk_id", F.concat_ws("_", "path", F.col("chunk_index").cast("string")))


def test_a_reindex_keeps_its_sparse_index_and_overtakes_nobody(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    one, two = {"a": "red fox\nblue bird", "b": "green frog"}, {"a": "red fox", "c": "blue whale\nred kite"}
    run = lambda texts, **o: reindex(spark, root, snapshot(spark, texts), chunked, models.HashEmbedder(8), **o)
    assert run(one).full_reason == "manifest_missing"
    assert run(two).full_reason is None
    queries = spark.createDataFrame([(1, "red"), (2, "blue bird")], "query_id bigint, text string")
    found = bm25.search(sparse_index(spark, store.current(spark, root)), queries, 5, zero_fill=False).collect()
    assert {(r["query_id"], r["key"]) for r in found} == {(1, "a_0"), (1, "c_1"), (2, "c_0")}

    def overtaken(stage, share):
        if stage == "chunked":
            store.publish(spark, root, store.current(spark, root))

    before = store.current(spark, root)
    with pytest.raises(store.Conflict):
        run(one, progress=overtaken)
    assert store.current(spark, root) == before
    store.Lease.acquire(spark, root, "other", 60).release(spark)
    heard = []
    done = exclusive_reindex(spark, root, "me", snapshot(spark, one), chunked, models.HashEmbedder(8), progress=lambda stage, share: heard.append(stage))
    assert done.counts == {"changed": 1, "new": 1, "deleted": 1} and heard[-1] == "published"
    lease = store.Lease.acquire(spark, root, "other", 60)
    with pytest.raises(store.Busy):
        exclusive_reindex(spark, root, "me", snapshot(spark, two), chunked, models.HashEmbedder(8))
    lease.release(spark)


def clusters(seed, n, dims=8, centers=12):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (centers, dims))
    return (middle[r.integers(0, centers, n)] + r.normal(0, 0.03, (n, dims))).tolist()


@pytest.mark.parametrize(("metric", "block"), [("l2sq", 1024), ("cosine", 1024), ("l2sq", 16), ("cosine", 16)])
def test_cells_lose_no_neighbour(spark, tmp_path, monkeypatch, metric, block):
    rows = [(i, v) for i, v in enumerate(clusters(1, 600))] + [(1000 + i, clusters(2, 1)[0]) for i in range(300)] + [(2000, [0.0] * 8), (2001, None), (2002, [1.0, None] * 4), (2003, [1.0])]
    monkeypatch.setattr(cells, "VECTOR_BUCKET", 64)
    monkeypatch.setattr(cells, "QUERY_BLOCK", block)
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    queries = vectors.filter("vec_id % 20 = 0 AND vec_id != 2000").select(F.col("vec_id").alias("query_id"), "embedding")
    usable = vectors.filter("vec_id != 2000")
    index = cells.write_cells(usable, f"file://{tmp_path}/cells", metric)
    assert index.vectors.count() == 900 and index.cells.agg(F.max("splits")).first()[0] > 1
    got, pairs = cells.nearest_in_cells(index, queries, 7)
    want = dense.nearest(usable, queries, 7, metric)
    told = lambda found: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 9)) for r in found.collect())
    assert told(got) == told(want)
    assert 0 < pairs["searched"] < 0.5 * pairs["all"]
    everything, _ = cells.nearest_in_cells(index, queries.limit(2), 5000)
    assert everything.count() == 2 * 900
    assert cells.nearest_in_cells(index, queries.limit(0), 3)[0].count() == 0


def test_cells_of_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<double>")
    index = cells.write_cells(none, f"file://{tmp_path}/cells")
    assert cells.nearest_in_cells(index, spark.createDataFrame([(1, [1.0])], "query_id bigint, embedding array<double>"), 3)[0].count() == 0


def related_by_pairs(docs, sources, limit):
    words = lambda t: {w for w in t.lower().replace(".", " ").replace("/", " ").split() if len(w) > 3}
    folder = lambda p: p.rpartition("/")[0]
    best = {}
    for nth, (path, title) in enumerate(sources):
        for doc in docs:
            up = folder(doc)
            score = min(4, len(words(doc) & words(title))) + (9 if up and up == folder(path) else 3 if folder(path) and doc.startswith(folder(path) + "/") else 0)
            if doc != path and score and (doc not in best or score > best[doc][0]):
                best[doc] = (score, path)
    return sorted(((-score, doc, path) for doc, (score, path) in best.items()))[:limit]


@pytest.mark.parametrize("common", [0, 20, 10_000])
def test_related_documents_equal_all_pairs(spark, common):
    r = random.Random(5)
    names = ["alpha", "beta", "gamma", "delta", "report", "notes"]
    docs = sorted({f"{'/'.join(r.choices(['x', 'yy', 'long'], k=r.randint(0, 3)))}/{' '.join(r.choices(names, k=3))} {i % 9}.txt".lstrip("/") for i in range(80)})
    sources = [(p, " ".join(r.choices(names, k=2))) for p in r.sample(docs, 12)] + [("x/elsewhere.txt", "Report.alpha"), ("top.txt", "")]
    d = spark.createDataFrame([(p,) for p in docs], "path string")
    s = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(sources)], "path string, title string, nth bigint")
    got = quality_reports.related_documents(d, s, 50, common).collect()
    assert [(-x["points"], x["path"], x["source_path"]) for x in got] == related_by_pairs(docs, sources, 50)


def test_a_word_that_all_have_makes_no_product(spark):
    d = spark.range(5000).select(F.concat(F.lit("docs/report "), (F.col("id") % 50).cast("string"), F.lit("/x"), F.col("id").cast("string"), F.lit(".txt")).alias("path"))
    s = spark.range(500).select(F.concat(F.lit("src"), F.col("id").cast("string"), F.lit("/y.txt")).alias("path"), F.concat(F.lit("report s"), F.col("id").cast("string")).alias("title"), F.col("id").alias("nth"))
    joined = []
    plain = type(d).join

    def counted(self, other, *args, **options):
        out = plain(self, other, *args, **options)
        joined.append(out)
        return out

    import unittest.mock

    with unittest.mock.patch.object(type(d), "join", counted):
        got = quality_reports.related_documents(d, s, 20)
    assert {r["points"] for r in got.collect()} == {1} and {r["source_path"] for r in got.collect()} == {"src0/y.txt"}
    assert max(x.count() for x in joined) <= 20_000  # of 2,500,000 pairs


def log_of(spark, tmp_path, ids):
    return event_log.append_events(spark.createDataFrame([(i, f'{{"id":{i}}}') for i in ids], "id bigint, body string"), f"file://{tmp_path}/log", "id")


def test_an_event_stream_goes_on_behind_its_offset(spark, tmp_path, monkeypatch):
    folder, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    parse = lambda batch: batch.withColumn("id", F.get_json_object("body", "$.id").cast("bigint"))
    bad = F.col("id") % 10 == 3
    assert log_of(spark, tmp_path, range(50, 0, -1)) == (0, 50)
    with streams.ProgressLog(spark) as told:
        streams.take_events(event_log.event_stream(spark, folder), out, bad, parse)
        assert log_of(spark, tmp_path, range(100, 130)) == (50, 80) and log_of(spark, tmp_path, []) == (80, 80)
        streams.take_events(event_log.event_stream(spark, folder), out, bad, parse)
        streams.take_events(event_log.event_stream(spark, folder), out, bad, parse)  # nothing new
        for _ in range(50):
            if sum(b[3] for b in told.batches) >= 80:
                break
            time.sleep(0.1)
    assert sum(r["rows"] for r in told.rows().collect()) == 80
    kept, dead = spark.read.parquet(f"{out}/accepted").collect(), spark.read.parquet(f"{out}/dead").collect()
    assert sorted((r["offset"], r["id"]) for r in kept + dead) == list(enumerate([*range(1, 51), *range(100, 130)]))
    assert {r["id"] for r in dead} == {3, 13, 23, 33, 43, 103, 113, 123}
    real, late = event_log.end_offset, [50]
    monkeypatch.setattr(event_log, "end_offset", lambda *a: late.pop() if late else real(*a))
    with pytest.raises(store.Conflict):  # it began before the others were appended
        log_of(spark, tmp_path, [7])
    assert real(spark, folder) == 80


def test_a_reader_repeats_a_batch_and_keeps_to_its_bound(spark, tmp_path):
    log_of(spark, tmp_path, range(100))
    log_of(spark, tmp_path, range(200, 250))
    reader = event_log.EventLogReader(f"file://{tmp_path}/log", 40)
    rows = lambda start, end: [(o, b) for span in reader.partitions({"next": start}, {"next": end}) for batch in reader.read(span) for o, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    first = rows(0, 40)
    assert first == rows(0, 40) == [(i, f'{{"id":{i}}}') for i in range(40)]
    assert reader.latestOffset() == {"next": 80}
    assert rows(90, 110) == [(i, f'{{"id":{i if i < 100 else i + 100}}}') for i in range(90, 110)] and rows(7, 7) == []


def test_an_export_appears_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    page = "<html><head><title>T &amp; x - XWiki</title></head><body><nav>n</nav><div id='xwikicontent'><p onclick='y()' class='k'>a &lt; b</p><script>s</script><br></div></body></html>"
    rows = [(3, "http://a.x/bin/view/Main/Sub%20Page/WebHome", page), (1, "http://a.x/bin/view/Main/Sub+Page/Other", page), (2, "http://a.x/con/x", page.replace("T &amp; x - XWiki", "")), (4, None, None)]
    cleaned = export.cleaned_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = {r["page_id"]: r for r in cleaned.collect()}
    assert got[1]["path"] == "Main/Sub Page/T & x.html" and got[3]["path"].startswith("Main/Sub Page/T & x-") and got[2]["path"] == "con_/page 2.html"
    assert '<p class="k">a &lt; b</p><br>' in got[1]["content"] and "nav" not in got[1]["content"] and "script" not in got[1]["content"]
    assert export.export(cleaned, root) == 1
    told = {r["path"]: r for r in export.manifest(spark, root).collect()}
    assert set(told) == {r["path"] for r in got.values()}
    version = store.current(spark, root).removeprefix("file://")
    assert all(open(f"{version}/{r['location']}").read() == next(g["content"] for g in got.values() if g["path"] == p) for p, r in told.items())
    with pytest.raises(Exception, match="needs a path"):
        export.export(spark.createDataFrame([(f"x{i}", None if i == 30 else "y") for i in range(40)], "path string, content string").repartition(4), root)
    assert {p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("version-")} == {version.rsplit("/", 1)[1]}
    assert store.current(spark, root).endswith(version)


def test_logs_are_cut_by_size(spark, tmp_path):
    root = f"file://{tmp_path}/logs"
    export.export(spark.range(100).select(F.lit("llm/exchange.jsonl").alias("path"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("content")).coalesce(2), root, most_bytes=100)
    told = export.manifest(spark, root).collect()
    version = store.current(spark, root).removeprefix("file://")
    lines_ = [line for r in told for line in open(f"{version}/{r['location']}").read().splitlines()]
    assert sorted(lines_) == sorted(f"line {i}" for i in range(100)) and all(0 < r["bytes"] <= 100 for r in told) and len({r["path"] for r in told}) == len(told)


def test_a_lookup_reads_few_files(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("id"), F.col("id").alias("n")).unionByName(spark.createDataFrame([(None, 7)], "id string, n bigint"))
    lookup.write_store(rows, folder, "id", 32)
    wanted = rows.filter("n IN (17, 4000)").select("id", (-F.col("n")).alias("position")).unionByName(spark.createDataFrame([("none", 1), (None, 2)], "id string, position bigint"))
    found = lookup.by_ids(spark, folder, wanted.unionByName(wanted))
    assert [r["n"] for r in found.orderBy("position").collect()] == [4000, 4000, 17, 17]
    found.collect()
    leaf = next(x for x in _leaves(found._jdf.queryExecution().executedPlan()) if "part#" in x.toString())
    assert 1 <= leaf.metrics().apply("numFiles").value() <= 3
    lookup_many = lookup.FEW_IDS
    try:
        lookup.FEW_IDS = 1
        assert [r["n"] for r in lookup.by_ids(spark, folder, wanted).orderBy("position").collect()] == [4000, 17]
    finally:
        lookup.FEW_IDS = lookup_many
    assert lookup.by_ids(spark, folder, wanted.limit(0)).count() == 0


def _leaves(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    found = plan.collectLeaves()
    out = []
    for i in range(found.size()):
        leaf = found.apply(i)
        name = leaf.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            out += _leaves(leaf.plan())
        elif "numFiles" in leaf.metrics().keys().mkString(","):
            out.append(leaf)
    return out


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_line_differences():
    r = random.Random(3)
    for _ in range(300):
        a, b = (r.choices("abcdef", k=r.randint(0, 9)) for _ in range(2))
        same = lines.matched(a, b)
        assert all(a[i] == b[j] for i, j in same) and all(i < k and j < m for (i, j), (k, m) in combinations(same, 2))
        assert len(same) == longest_common(a, b)
    a = [f"line {i}" for i in range(100_000)]
    b = [x for i, x in enumerate(a) if i % 1000] + ["same"] * 500
    began = time.time()
    assert len(lines.matched(a, b)) == 99_900 and time.time() - began < 10
    c = ["x", "y"] * 30_000
    d = ["y", "x", "x"] * 20_000
    same = lines.matched(c, d)
    assert all(c[i] == d[j] for i, j in same) and len(same) > 20_000 and time.time() - began < 20
    shuffled = r.sample(a[:5000], 5000)
    assert len(lines.matched(a[:5000], shuffled)) == len(lines.rising([(i, shuffled.index(x)) for i, x in enumerate(a[:5000])]))
    assert lines.difference("a\n\nb", "b\nc") == (0.5, ["c"], ["a"]) and lines.difference(None, "")[0] == 1.0


def test_word_packages_by_their_styles(spark):
    styles = [("A", "My head", "B"), ("B", "Heading 2", ""), ("H1", "heading 1", "Normal"), ("Loop", "x", "Loop")]
    told = [("Normal", "intro"), ("H1", "One"), ("Normal", "under <one> & more"), ("A", "Deep"), ("Loop", "below"), ("H1", "Two"), ("Normal", " ")]
    blocks = docx.docx_blocks(docx.docx_package(told, styles), "Title")
    assert [(t, s, k) for t, s, k, _ in blocks] == [("intro", "Title", "text"), ("One", "One", "heading"), ("under <one> & more", "One", "text"), ("Deep", "One → Deep", "heading"), ("below", "One → Deep", "text"), ("Two", "Two", "heading")]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t><w:tab/><w:t>z</w:t></w:r></w:p>"
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:tbl><w:tr><w:tc>{p('c1')}</w:tc><w:tc><w:p/></w:tc><w:tc>{p('c2')}</w:tc></w:tr></w:tbl>{p('after')}</w:body></w:document>")
    assert [(t, k) for t, _, k, _ in docx.docx_blocks(held.getvalue())] == [("after\tz", "text"), ("c1\tz | c2\tz", "table_row")]
    long = "A sentence that is long enough to be kept as it is. " * 4
    whole = docx.docx_package([("H1", "Head"), ("Normal", long)], styles)
    rows = [(1, "a.DOCX", "t", "flat", whole), (2, "b.docx", "t", long, b"broken"), (3, "c.txt", "t", long, None)]
    files = spark.createDataFrame(rows, "doc_id bigint, path string, title string, text string, content binary")
    got = {(r["doc_id"], r["strategy"], r["section_path"]) for r in chunking.chunk_files(files).collect()}
    assert got == {(1, "docx", "Head"), (2, "paragraphs", "t → t"), (3, "paragraphs", "t → t")}


def test_embeddings_are_kept_between_runs(spark, tmp_path, monkeypatch):
    class Counting:
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no vector")
            return [[float(len(t))] for t in texts]

    root = f"file://{tmp_path}/cache"
    texts = lambda some: spark.createDataFrame([(t,) for t in some], "text string")
    run = lambda some, now, capacity=99: embedding_store.embedded(spark, root, texts(some), Counting(), "m", now, 100, capacity)
    assert run(["a", "bb", "bb", None], 10)[1] == {"found": 0, "embedded": 2}
    found, told = run(["bb", "ccc"], 50)
    assert told == {"found": 1, "embedded": 1} and sorted(r["embedding"][0] for r in found.collect()) == [2.0, 3.0]
    with pytest.raises(Exception, match="could not be embedded"):
        run(["dddd", "bad"], 60)
    assert run(["a", "bb"], 120)[1] == {"found": 0, "embedded": 2}  # made at 10: too old
    assert run(["ccc"], 130, 2)[1] == {"found": 1, "embedded": 0}  # of a and bb one has no room
    kept = {(r["key"], r["created"], r["used"]) for r in embedding_store.entries(spark, root, 130, 100).collect()}
    assert len(kept) == 2 and {(c, u) for _, c, u in kept} == {(50, 130), (120, 120)}
    monkeypatch.setattr(embedding_store, "MOST_GENERATIONS", 2)
    assert run(["ccc", "e"], 140)[1] == {"found": 1, "embedded": 1}
    after = embedding_store.entries(spark, root, 140, 100)
    assert sorted((r["created"], r["used"]) for r in after.collect()) == [(50, 140), (120, 120), (140, 140)] and len(embedding_store._state(spark, root)["entries"]) == 1
    real, late = store.last, [1]
    monkeypatch.setattr(store, "last", lambda *a: late.pop() if late else real(*a))
    with pytest.raises(store.Conflict):  # it began before others were published
        run(["zz"], 141)


def test_a_maintained_corpus_gets_more_parts_as_it_grows(spark, tmp_path):
    text = "Some sentence that is long enough to be kept. " * 30
    for n in range(6):
        spark.createDataFrame([(n * 5 + i, f"{n} {text}") for i in range(5)] + [(0, f"{n} again {text}")], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema("doc_id bigint, text string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        got = streams.maintain_chunks(stream, f"file://{tmp_path}/kept", part_chunks=10)
    told = streams._parts(spark, f"file://{tmp_path}/kept")
    assert told["ways"] > 1 and sum(n for _, n in told["parts"].values()) == got.count()
    assert {r["doc_id"] for r in got.collect()} == set(range(30)) and all(r["text"].startswith("5 again") for r in got.filter("doc_id = 0 AND chunk_index = 0").collect())


@pytest.mark.parametrize(("size", "few"), [(8, 500_000), (40, 0)])
def test_a_maintained_corpus_equals_the_last_texts(spark, tmp_path, monkeypatch, size, few):
    monkeypatch.setattr(streams, "BROADCAST_DOCUMENTS", few or 1)
    r, last, folder = random.Random(size), {}, f"file://{tmp_path}/data/kept"
    told = lambda n: " ".join(r.choices(WORDS, k=n)) + "."
    for n in range(7):
        rows = [(r.randrange(60), told(r.choice([1, 30, 400]))) for _ in range(7)] + [(100 + 3 * n + i, told(60)) for i in range(3)]
        rows += [(rows[0][0], "z" + rows[0][1])] * (n % 2)
        rows += [(100 + 3 * n - 3, None)] * (n == 4)  # a document that is empty now
        last |= {i: max((t or "" for k, t in rows if k == i)) for i, _ in rows}
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema("doc_id bigint, text string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        got = streams.maintain_chunks(stream, folder, part_chunks=size)
        want = {(k, c["chunk_index"], c["start"], c["text"]) for k, c in ((c["doc_id"], c) for c in chunking.fixed_chunks(spark.createDataFrame(list(last.items()), "doc_id bigint, text string")).collect())}
        assert sorted(tuple(c) for c in got.collect()) == sorted(want)
        state = streams._parts(spark, folder)
        assert state["batch"] == n and sum(left for _, left in state["parts"].values()) == len(want) and state["ways"] == len(state["parts"])
    assert len(state["gone"]) < 6 and (size == 8 or len(state["parts"]) < 7)


def test_a_batch_writes_its_own_chunks_only(spark, tmp_path):
    folder = f"file://{tmp_path}/kept"
    for n in range(8):
        spark.createDataFrame([(n * 10 + i, f"{n} {i} " + "Some sentence that is long enough to be kept. " * 30) for i in range(10)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("doc_id bigint, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streams.maintain_chunks(stream, folder, part_chunks=25)
    written = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/data").count()
    assert streams._parts(spark, folder)["batch"] == 7 and written == got.count() == 8 * 10 * 4


def test_a_corpus_of_the_old_layout_goes_on(spark, tmp_path):
    folder, text = f"file://{tmp_path}/kept", "Some sentence that is long enough to be kept, surely so. "
    old = chunking.fixed_chunks(spark.createDataFrame([(1, "a " + text), (2, "b " + text)], "doc_id bigint, text string"))
    old.withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{folder}/data/batch=-1")
    store.publish(spark, folder, '{"batch": -1, "ways": 1, "parts": {"0": [-1, 2]}}')
    spark.createDataFrame([(2, "c " + text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/in")
    got = streams.maintain_chunks(spark.readStream.schema("doc_id bigint, text string").parquet(f"{tmp_path}/in"), folder)
    assert {(c["doc_id"], c["text"][0]) for c in got.collect()} == {(1, "a"), (2, "c")}


def test_line_changes_count_equal_lines_each(spark):
    pairs = spark.createDataFrame([("p", "a\na\n b", "b\na\nc\n\n"), ("q", None, "x"), ("r", None, None)], "path string, old string, new string")
    got = {r["path"]: (r["n_lines"], r["n_added"], r["n_removed"]) for r in quality_reports.line_changes(pairs).collect()}
    assert got == {"p": (6, 1, 1), "q": (1, 1, 0), "r": (0, 0, 0)}


def test_duplicate_names_show_their_first_paths(spark):
    rows = spark.range(200).select(F.concat((F.col("id") % 100).cast("string"), F.lit("/"), F.when(F.col("id") < 150, "Same.txt").otherwise(F.concat("id", F.lit(".txt")))).alias("path"))
    got = quality_reports.duplicate_names(rows).collect()
    assert [(r["name"], r["files"], r["paths"].count(",")) for r in got] == [("same.txt", 150, 4)]


def test_a_document_is_one_row_of_the_index(spark, tmp_path):
    rows = [(1, "b a b"), (2, None), (3, "c"), (3, "c a"), (4, "...")]
    corpus = spark.createDataFrame(rows, "id bigint, text string")
    index = bm25.write_index(corpus, "id", "id", f"file://{tmp_path}/index")
    assert sorted(r["id"] for r in index.parts[0].collect()) == [1, 2, 3, 4]
    assert sorted((r["id"], r["term"], r["tf"]) for r in index.postings.collect()) == [(1, "a", 1), (1, "b", 2), (3, "a", 1), (3, "c", 2)]
    assert {r["term"]: r["df"] for r in index.terms.collect()} == {"a": 2, "b": 1, "c": 1} and index.size.first()["n_docs"] == 5
    plan = bm25.counted(corpus, "id", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # postings are counted where their text is
    assert "array_sort" not in plan  # which would call a function for each comparison


def test_an_index_build_moves_texts_not_counted_words(spark, tmp_path, monkeypatch):
    plans, plain = [], bm25.write_bucketed
    monkeypatch.setattr(bm25, "write_bucketed", lambda docs, *a: plans.append(docs._jdf.queryExecution().optimizedPlan().toString()) or plain(docs, *a))
    monkeypatch.setattr(bm25, "BUCKET_POSTINGS", 20)
    texts = {i: " ".join(random.Random(i).choices(WORDS, k=i % 9)) for i in range(120)} | {120: None, 121: ""}
    corpus = spark.createDataFrame([(k, k % 11, t) for k, t in texts.items()], "id bigint, home bigint, text string")
    for home in ((), ("home",)):
        index = bm25.write_index(corpus, "id", "id", f"file://{tmp_path}/index{len(home)}", home=home)
        want = {(k, w): n for k, t in texts.items() for w, n in Counter((t or "").split()).items()}
        assert {(r["id"], r["term"]): r["tf"] for r in index.postings.collect()} == want
        assert {r["id"]: r["dl"] for r in index.docs.collect()} == {k: len((t or "").split()) for k, t in texts.items()}
        assert {r["term"]: r["df"] for r in index.terms.collect()} == Counter(w for _, w in want) and index.size.first()["n_docs"] == 122
        assert spark.read.parquet(f"file://{tmp_path}/index{len(home)}/postings-shape").first()[0] > 8
    assert all(plan.index("regexp_extract_all") < plan.index("RepartitionByExpression") for plan in plans) and len(plans) == 2  # dealt, then counted
    none = bm25.write_index(corpus.limit(0), "id", "id", f"file://{tmp_path}/none")
    assert none.terms.isEmpty() and none.docs.isEmpty() and none.size.first()["n_docs"] == 0


def test_a_fused_pool_of_few_queries_leaves_the_texts_where_they_are(spark):
    rankings = spark.range(40).select((F.col("id") % 2).alias("query_id"), F.lit(0).alias("list_id"), F.col("id").alias("doc_id"), F.floor(F.col("id") / 2).alias("rank"))
    store = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = fusion.fused_topk(rankings, store, "doc_id", n_queries=2), fusion.fused_topk(rankings, store, "doc_id", n_queries=1_000_000)
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) != []
        plans = [found._jdf.queryExecution().executedPlan().toString() for found in (few, many)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert ["BroadcastHashJoin" in plan for plan in plans] == [True, False]


def test_contenders_lose_no_rank(spark):
    scores = spark.range(4000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("ord"), F.floor(F.rand(1) * 50).cast("double").alias("score"))
    scores = scores.unionByName(spark.createDataFrame([(9, 1, -1.0), (9, 2, -2.0)], scores.schema)).cache()
    held = bm25.contenders(scores, 5, "ord")
    told = lambda some: sorted(map(tuple, bm25.ranked(some, 5, "ord").collect()))
    assert told(held) == told(scores) and held.count() < 0.2 * scores.count()


def test_queries_come_once_to_a_part_of_the_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "QUERY_BLOCK", 8)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(clusters(3, 400))], "vec_id bigint, embedding array<double>")
    bounds = cells.Bounds(cells.write_cells(vectors, f"file://{tmp_path}/cells"))
    asked = vectors.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), F.lit(None).cast("double").alias("limit"))
    dealt = cells._dealt(cells._wanting(asked, bounds, 9)).collect()
    assert len(dealt) == 100 and len({r["block"] for r in dealt}) <= 5  # one part; of 32 queries a block
