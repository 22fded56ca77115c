"""Operators on small cases of their own."""

import inspect
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrystone.config import Settings
from quarrystone.functions import html, models
from quarrystone.functions import text as T
from quarrystone.operators import admission, bm25, chunking, context, dense, fusion, history, manifest, quality_reports
from quarrystone.plans import retrieval_queries
from quarrystone.plans.retrieval import deep_retrieve, retrieve
from quarrystone.sources import files, pages
from quarrystone.streaming import streams


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("size", "overlap"), [(100, 100), (100, 120), (0, 0), (100, 52)])
def test_overlaps_that_would_not_move_on_are_rejected(size, overlap):
    with pytest.raises(ValueError, match="overlap|positive"):
        Settings(chunk_size=size, chunk_overlap=overlap)
    assert Settings().with_changes(top_k=7).top_k == 7


def test_fixed_windows_back_off_to_sentences():
    text = "a" * 251 + "." + "b" * 400
    assert [w for _, w in chunking.fixed_windows(text, 500, 50)][0] == "a" * 251 + "."
    assert [len(w) for _, w in chunking.fixed_windows("a" * 250 + "." + "b" * 400, 500, 50)][0] == 500
    assert list(chunking.fixed_windows("", 500, 50)) == []
    for n in (50, 51, 500, 501):
        assert "".join(w[50 * (i > 0) :] for i, (_, w) in enumerate(chunking.fixed_windows("x" * n, 500, 50))) == "x" * n


def test_paragraphs_get_their_headings():
    text = "INTRO\nfirst body\n\nPlain paragraph\n\nNotes:\nsecond body\n\nONLY HEADING"
    blocks = chunking.paragraph_blocks(text, "title")
    assert [(b[0], b[1]) for b in blocks] == [("first body", "title → INTRO"), ("Plain paragraph", "title → INTRO"), ("second body", "title → Notes"), ("ONLY HEADING", "title → Notes")]
    assert chunking.paragraph_blocks("  \n ", "t") == []


def test_small_blocks_merge_within_a_section():
    blocks = [("a" * 50, "s", "text", []), ("b" * 60, "s", "text", []), ("c" * 10, "t", "text", []), ("d" * 1300, "t", "text", [])]
    merged = chunking.merged_blocks(blocks, 1200, 80)
    assert [(len(m[0]), m[1]) for m in merged] == [(50 + 2 + 60 + 2 + 10, "s"), (1300, "t")]
    assert chunking.merged_blocks([("short", "s", "text", [])], 1200, 80) == []


PAGE = """<html><head><title>Page</title></head><body><h1>One</h1><p>text <del>old</del> end</p><nav>menu</nav><!-- note -->
<h2>Two</h2><ul><li>x</li><li>y <ul><li>z</li></ul></li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><pre>code</pre>
<h1></h1><div><span>inner</span></div><p style="TEXT-DECORATION: line-through">gone</p></body></html>"""


def test_html_blocks_follow_the_structure():
    blocks = html.page_blocks(PAGE)
    kinds = [b[2] for b in blocks]
    assert kinds.count("heading") == 2 and {"list", "table", "code", "text"} <= set(kinds)
    by_kind = {b[2]: b for b in blocks}
    assert by_kind["list"][0] == "- x\n- y z" and by_kind["table"][0] == "a | b\n1 | 2" and by_kind["code"][0] == "code"
    assert by_kind["table"][1] == "Page → One → Two"
    assert "menu" not in " ".join(b[0] for b in blocks) and "note" not in " ".join(b[0] for b in blocks)


@pytest.mark.parametrize(("mode", "want"), [("mark", "text [obsolete: old] end"), ("exclude", "text end"), ("keep", "text old end"), ("odd", "text [obsolete: old] end")])
def test_struck_out_text(mode, want):
    assert html.text_of(html.parse("<p>text <s>old</s> end</p>"), mode) == want
    struck = html.text_of(html.parse('<p style="x: 1; Text-Decoration:LINE-THROUGH">gone</p>'), mode)
    assert struck == {"exclude": "", "keep": "gone"}.get(mode, "[obsolete: gone]")


def test_bm25_zero_fill_and_ties(spark):
    corpus = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "c"), (3, ""), (4, "d d d")], "id bigint, text string").withColumn("ord", F.col("id"))
    queries = spark.createDataFrame([(1, "c c"), (2, ""), (3, "zzz"), (4, "a")], "query_id bigint, text string")
    got = {}
    for r in bm25.bm25_topk(corpus, queries, 3, "id", "ord").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {1: [2, 0, 1], 3: [0, 1, 2], 4: [0, 1, 2]}
    assert {r["query_id"] for r in bm25.bm25_topk(corpus, queries, 3, "id", "ord", zero_fill=False).collect()} == {1, 4}


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    vectors = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id bigint, embedding array<float>")
    got = dense.nearest(vectors, vectors.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id"), 3)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in got.collect()}[4, 1] == 3  # a tie with 5
    assert got.count() == 15
    monkeypatch.setattr(dense, "CELLS", 1)
    same = dense.nearest(vectors, vectors.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id"), 3, "l2sq")
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, got.collect()))
    odd = vectors.unionByName(spark.createDataFrame([(50, [1.0, None]), (51, [1.0]), (52, None)], vectors.schema))
    assert dense.nearest(odd, vectors.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id"), 99).count() == 20
    assert dense.nearest(odd, odd.filter("vec_id = 52").withColumnRenamed("vec_id", "query_id"), 3).count() == 0


def test_a_stored_index_is_reused_until_its_files_change(spark, tmp_path, monkeypatch):
    built = []
    plain = bm25.write_index
    monkeypatch.setattr(bm25, "write_index", lambda *a, **k: built.append(1) or plain(*a, **k))
    path, root = f"{tmp_path}/corpus", f"file://{tmp_path}/bm25"
    spark.createDataFrame([(0, "a b"), (1, "a c c"), (2, None)], "id bigint, text string").write.parquet(path)

    def index(settings=None):
        return bm25.stored_index(spark.read.parquet(path), "id", "id", bm25.corpus_version(spark, [path], settings), settings, root)

    first = index()
    assert {(r["term"], r["df"]) for r in first.terms.collect()} == {("a", 2), ("b", 1), ("c", 1)} and first.size.first()["n_docs"] == 3
    queries = spark.createDataFrame([(1, "c"), (2, "a b")], "query_id bigint, text string")
    transient = bm25.bm25_topk(spark.read.parquet(path).withColumn("ord", F.col("id")), queries, 2, "id", "ord")
    assert sorted(map(str, bm25.search(index(), queries, 2).select("query_id", "id", "score", "rank").collect())) == sorted(map(str, transient.select("query_id", "id", "score", "rank").collect()))
    assert len(built) == 1
    spark.createDataFrame([(3, "d")], "id bigint, text string").write.mode("append").parquet(path)
    assert index().size.first()["n_docs"] == 4 and len(built) == 2
    assert index(Settings(bm25_epsilon=0.5)).size.first()["n_docs"] == 4 and len(built) == 3


def test_a_dense_search_builds_no_index(spark, sf_dir, monkeypatch):
    def built(*args, **options):
        raise AssertionError("a dense search reads no postings")

    monkeypatch.setattr(bm25, "stored_index", built)
    monkeypatch.setattr(bm25, "bm25_topk", built)
    assert {r["stage"] for r in retrieval_queries.dense_search(spark, sf_dir).collect()} == {"dense"}
    with pytest.raises(AssertionError, match="no postings"):
        retrieval_queries.hybrid_search(spark, sf_dir)


def test_ranks_keep_the_window_limit(spark):
    scores = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("ord"), F.rand(1).alias("score"))
    assert "WindowGroupLimit" in bm25.ranked(scores, 5, "ord")._jdf.queryExecution().toString()


def test_retrieval_modes_degrade(spark):
    corpus = spark.createDataFrame([(0, "alpha beta"), (1, "beta gamma"), (2, "delta")], "id bigint, text string").withColumn("ord", F.col("id"))
    queries = spark.createDataFrame([(1, "gamma")], "query_id bigint, text string")
    e = models.HashEmbedder(16)
    vectors = models.embed(corpus.select(F.col("id").alias("vec_id"), "text"), e, "vec_id").withColumn("id", F.col("vec_id"))
    asked = models.embed(queries, e, "query_id")
    both = retrieve(corpus, vectors, queries, asked, "id", "ord").orderBy("position").collect()
    assert both[0]["id"] == 1 and both[0]["stage"] == "hybrid" and both[0]["score"] == pytest.approx(2 / 61 / 0.15)
    assert retrieve(corpus, None, queries, None, "id", "ord").first()["stage"] == "sparse_fallback"
    assert retrieve(corpus, None, queries, None, "id", "ord", Settings(mode="dense")).count() == 0


def test_deep_search_says_why_it_ends(spark):
    queries = spark.createDataFrame([(1, "q")], "query_id bigint, text string")

    def search(texts):
        return texts.groupBy("query_id").agg((F.count("*") * 0.2).alias("score")).withColumn("id", F.lit(7).cast("bigint"))

    def widen(texts, pool):
        return texts.withColumn("text", F.concat("text", F.lit("+")))

    found, reasons = deep_retrieve(search, queries, widen, "id")
    assert reasons == ["widened", "widened", "good_enough"] and found.first()["score"] == pytest.approx(0.6)
    assert deep_retrieve(search, queries, lambda texts, pool: texts, "id")[1] == ["no_new_queries"]


@pytest.mark.parametrize("broken", ["plan", "task"])
def test_a_failed_round_of_a_deep_search_is_no_result(spark, broken):
    queries = spark.createDataFrame([(1, "q")], "query_id bigint, text string")
    rounds = []

    def search(texts):
        rounds.append(texts)
        if len(rounds) == 2 and broken == "plan":
            raise RuntimeError("no such index")
        score = F.raise_error(F.lit("no such index")).cast("double") if len(rounds) == 2 else F.lit(0.2)
        return texts.select("query_id", F.lit(7).cast("bigint").alias("id"), score.alias("score"))

    with pytest.raises(Exception, match="no such index"):
        deep_retrieve(search, queries, lambda texts, pool: texts.withColumn("text", F.concat("text", F.lit("+"))), "id")[0].collect()
    assert len(rounds) == 2


def test_context_takes_what_fits(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x" * 40), (1, 2, "b", "y" * 100), (1, 3, "c", "z")], "query_id int, position int, label string, text string")
    got = context.packed_context(rows, Settings(max_context_chars=120)).orderBy("position").collect()
    assert [(r["position"], r["truncated"]) for r in got] == [(1, False), (2, True)] and got[1]["block"].endswith("...")
    assert context.packed_context(rows, Settings(max_context_chars=60)).count() == 1
    assert context.SEPARATOR in context.context_text(context.packed_context(rows)).first()["context"]


def test_footers_and_pools(spark):
    cited = spark.createDataFrame([(1, i, f"s{i}", 0.5) for i in range(7)], "query_id int, position int, label string, score double")
    assert context.citation_footer(cited).first()["footer"].split("\n")[4] == "5. s4 (50.00%)"
    rounds = spark.createDataFrame([(1, "a", 0.5, 0), (1, "a", 0.5, 1), (1, "b", 0.6, 1)], "query_id int, id string, score double, round int")
    assert [(r["id"], r["round"]) for r in fusion.merged_pool(rounds, "id", 5).orderBy("position").collect()] == [("b", 1), ("a", 0)]


def test_texts_and_names(spark):
    assert one(spark, T.clip("t", 10), t="  a  b\n c defghijkl") == "a b c d..."
    assert one(spark, T.clean_component("t"), t='a<b>:"c. ') == "a_b_c" and one(spark, T.clean_component("t"), t="con") == "_con"
    assert len(one(spark, T.clean_component("t", 40), t="n" * 100)) == 40
    assert one(spark, T.normal_url("t"), t="HTTP://Host.x//a///b/?q=1#f") == "http://host.x/a/b" and one(spark, T.url_space("t"), t="http://h/x/y") == "x"
    assert one(spark, T.sigmoid("x"), x=-1e9) == pytest.approx(0) and one(spark, T.sigmoid("x"), x=1e9) == pytest.approx(1)
    assert one(spark, T.topic_key("t", ["over"]), t="a bb cc") == "a bb cc" and one(spark, T.topic_key("t", ["over"]), t="Over the Hills Again") == "hills again"
    assert one(spark, T.join_path(F.array(F.lit("a"), F.lit(" "), F.lit("b")))) == "a → b"
    assert one(spark, T.highlight("t", F.array(F.lit("x"))), t="axa x") == "a**x**a **x**"


def test_admission(spark):
    lexicon = admission.Lexicon(("invoice",), ("thanks",), ("hello",), ("weather",))
    want = {"Thanks!": "chitchat", "hello there": "chitchat", "hello there my friend": "retrieve", "the weather today": "off_topic", "hello invoice": "retrieve", "": "retrieve"}
    assert {q: one(spark, admission.route(F.col("q"), lexicon), q=q) for q in want} == want
    assert one(spark, admission.admitted(F.col("q"), F.lit(False)), q="x" * 1001) == "too_long" and one(spark, admission.admitted(F.col("q"), F.lit(True)), q="") is None
    assert one(spark, admission.clamped_int(F.col("v"), 5, 1, 50), v="abc") == 5 and one(spark, admission.clamped_int(F.col("v"), 5, 1, 50), v="99") == 50
    assert one(spark, admission.attachment_kind(F.lit("A.PNG"))) == "image"
    cache = spark.createDataFrame([("a", [1.0])], "key string, embedding array<float>")
    assert admission.cache_misses(spark.createDataFrame([("a",), ("b",), ("b",)], "key string"), cache).collect() == [("b",)]


def test_weak_answers_by_the_first_reason(spark):
    rows = [("[]", '{"retrieve_error":"x"}'), ("[]", '{"diagnostics":{"retrieval_status":"no_hits"}}'), ("[]", "{}"), ('[{"score":0.3}]', None), ('[{"score":0.4}]', "{}"), ("broken", "{"), (None, None)]
    df = spark.createDataFrame(rows, "sources_json string, metadata_json string")
    assert [r["r"] for r in df.select(history.weak_reason().alias("r")).collect()] == ["retrieve_error", "bad_status", "no_sources", "low_score", None, "no_sources", "no_sources"]


def test_files_without_chunks_and_settings_are_in_the_manifest(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size_bytes int")
    c = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x")], "path string, chunk_index int, chunk_id string")
    assert {r["path"]: list(r["chunk_ids"]) for r in manifest.build_manifest(f, c, "h").collect()} == {"a": ["x", "y"], "b": []}
    assert manifest.full_rebuild_reason(True, 5, True, True, False) == "settings_changed" and manifest.full_rebuild_reason(True, 5, True, True, True) is None


def test_version_diff(spark):
    pairs = spark.createDataFrame([("p", "a\nb\n\nc", "a\nx\nc\nd"), ("q", None, None)], "path string, old string, new string")
    got = {r["path"]: r for r in quality_reports.version_diff(pairs).collect()}
    assert (got["p"]["added"], got["p"]["removed"]) == (["x", "d"], ["b"]) and got["q"]["ratio"] == 1.0


def office(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        for name, text in members.items():
            package.writestr(name, text)
    return out.getvalue()


def test_office_files_are_read_and_broken_ones_reported(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.DOCX").write_bytes(office({"word/document.xml": f"<w:document {w}><w:body>{p('Head')}{p('body')}<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl></w:body></w:document>"}))
    (tmp_path / "sub/b.xlsx").write_bytes(office({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>0</v></c><c/></row></sheetData></worksheet>'}))
    (tmp_path / "c.pptx").write_bytes(office({"ppt/slides/slide1.xml": f"<a:x {a}><a:p><a:r><a:t>Deck</a:t></a:r></a:p></a:x>"}))
    (tmp_path / "d.txt").write_bytes(b"plain \xff text")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "~$f.txt").write_bytes(b"temporary")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert got["a.DOCX"]["title"] == "Head" and got["a.DOCX"]["text"] == "Head body x | y"
    assert got["b.xlsx"]["text"] == "Sheet: S name | 0 |" and got["c.pptx"]["title"] == "Deck"
    assert got["d.txt"]["text"] == "plain � text" and got["e.docx"]["text"] is None and got["e.docx"]["error"]
    assert "~$f.txt" not in got


def test_archives_and_paths(spark, tmp_path):
    (tmp_path / "z.zip").write_bytes(office({"a%20b/../../c.txt": "hi"}))
    got = files.archive_members(files.scan(spark, str(tmp_path), ("zip",))).collect()
    assert [(r["member"], bytes(r["content"])) for r in got] == [("a b/c.txt", b"hi")]
    assert files.inside("/data", "a/../b") == "/data/b"
    with pytest.raises(ValueError, match="leads out"):
        files.inside("/data", "../x")


def test_json_lines_skip_what_is_no_object(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"question":"q"}\n\nbroken\n{"question":"r"}\n')
    assert sorted(r["question"] for r in files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "question string").collect()) == ["q", "r"]


def test_model_answers_are_read():
    assert models.string_list('["one thing", "two things"]') == ["one thing", "two things"]
    assert models.string_list('one thing", "two things"]') == ["one thing", "two things"]
    assert models.string_list('Sure: ["abc", "abc", "x"] done') == ["abc"]
    assert models.strip_reasoning("<think>a</think> b<think>c") == "b"


def test_rerank_keeps_order_when_the_model_fails(spark):
    found = spark.createDataFrame([(1, "x", 0.5, 1), (1, "word y", 0.4, 2), (1, "z", 0.3, 3)], "query_id bigint, text string, score double, position int")
    queries = spark.createDataFrame([(1, "word")], "query_id bigint, text string")
    order = lambda r: [x["text"] for x in r.orderBy("position").collect()]
    assert order(models.rerank(found, queries, models.OverlapReranker(), Settings(rerank_top_n=2))) == ["word y", "x", "z"]

    def broken(query, texts):
        raise RuntimeError("no model")

    assert order(models.rerank(found, queries, broken)) == ["x", "word y", "z"]


def test_links_and_crawl_order(spark):
    site = [(1, "http://a.x/", '<a href="/b">b</a><a href="#top">t</a>'), (2, "http://a.x/b", '<a href="c?x=1">c</a><a href="http://a.x/b">b</a>'), (3, "http://a.x/c", ""), (4, "http://a.x/z", None)]
    df = spark.createDataFrame(site, "page_id bigint, url string, html string")
    assert {(r["page_id"], r["target"]) for r in pages.links(df).collect()} == {(1, "http://a.x/b"), (2, "http://a.x/c"), (2, "http://a.x/b")}
    assert {r["url"]: r["depth"] for r in pages.crawl_order(df).collect()} == {"http://a.x": 0, "http://a.x/b": 1, "http://a.x/c": 2, "http://a.x/z": None}
    assert pages.extract_pages(df).count() == 4


def test_streams_keep_each_event_once(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(n * 10 + i, "error" if i == 3 else "view", 1, '{"k":1}' if i != 4 else "{") for i in range(5)], "event_id bigint, event_type string, user_id bigint, props string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    schema = "event_id bigint, event_type string, user_id bigint, props string"
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        streams.take_events(stream(), f"file://{tmp_path}/out", (F.col("event_type") == "error") | F.col("k").isNull(), lambda batch: batch.withColumn("k", F.from_json("props", "k bigint")["k"]))
    assert spark.read.parquet(f"{tmp_path}/out/accepted").count() == 9 and spark.read.parquet(f"{tmp_path}/out/dead").count() == 6


def test_crawl_order_follows_long_chains_and_keeps_every_page(spark):
    n = 40
    rows = [(i, f"http://a.x/{i:03}", f'<a href="/{i + 1:03}">next</a>') for i in range(n)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["url"]: r["depth"] for r in pages.crawl_order(df).collect()} == {f"http://a.x/{i:03}": i for i in range(n)}
    bounded = pages.crawl_order(df, max_pages=30, max_depth=20).collect()
    assert len(bounded) == 30 and max(r["depth"] for r in bounded if r["depth"] is not None) == 19
    assert inspect.signature(pages.crawl_order).parameters["max_pages"].default is None


def test_risk_summary_counts_the_tables(spark):
    votes = spark.createDataFrame([("up",), ("down",)], "rating string")
    said = [(1, 1, "user", "where?", None, 1), (2, 1, "assistant", "-", "[]", 2), (3, 2, "assistant", "-", '[{"score":0.9}]', 3), (4, 2, "assistant", "-", None, 4)]
    talk = spark.createDataFrame(said, "message_id int, session_id int, role string, content string, sources_json string, created_at int").withColumn("metadata_json", F.lit(None).cast("string"))
    rows = [("a/x.txt", 0, 1), ("b/X.txt", 5, 365), ("b/y.txt", 5, 365)]
    held = spark.createDataFrame(rows, "path string, size_bytes int, day int").selectExpr("path", "size_bytes", "timestamp_ntz'2023-01-01' + make_dt_interval(day) AS modified_at")
    now = F.expr("timestamp_ntz'2024-01-01'")
    got = quality_reports.risk_summary(votes, talk, held, now)
    assert got.first().asDict() == {"up": 1, "down": 1, "weak": 2, "gaps": 1, "stale": 1, "empty": 1, "duplicates": 1}
    assert quality_reports.risk_flags(got).first()["flags"] == "high_down_share,weak_answers,knowledge_gaps,stale_documents,duplicate_names,empty_documents"
    none = quality_reports.risk_summary(votes, talk.filter("message_id = 3"), held.filter("path = 'b/y.txt'"), now)
    assert quality_reports.risk_flags(none, 0.9).first()["flags"] == ""


def test_settings_from_text():
    got = Settings().from_text({"top_k": " 7 ", "min_score": "0.5", "mode": "dense"})
    assert (got.top_k, got.min_score, got.mode) == (7, 0.5, "dense")
    for bad in ({"top_k": "x"}, {"min_score": "nan"}, {"mode": "odd"}, {"none": "1"}):
        with pytest.raises(ValueError):
            Settings().from_text(bad)


def test_files_are_chunked_by_their_type(spark):
    long = "Some sentence that is long enough to stay. " * 4
    rows = [(1, "a/x.HTML", "t", f"<html><body><h1>Head</h1><p>{long}</p></body></html>"), (2, "b.txt", "t", f"INTRO\n{long}\n\n{long}"), (3, "c.csv", "t", long), (4, "d.html", "t", "")]
    files_ = spark.createDataFrame(rows, "doc_id bigint, path string, title string, text string")
    assert {(r["doc_id"], r["strategy"]) for r in chunking.chunk_files(files_).collect()} == {(1, "html"), (2, "paragraphs"), (3, "fixed")}
    assert {r["strategy"] for r in chunking.chunk_files(files_, structural=False).collect()} == {"fixed"}


def test_attachments_and_wider_queries(spark):
    from quarrystone.operators import attachments

    rows = spark.createDataFrame([(1, 2, "b.txt", "second  text"), (1, 1, None, "x" * 5000), (1, 3, "c", " "), (2, 1, "d", None)], "query_id int, nth int, filename string, text string")
    got = attachments.excerpts(rows).collect()
    assert len(got) == 1 and got[0]["excerpt"] == "[attachment]\n" + "x" * 4000 + "\n\n[b.txt]\nsecond  text"
    asked = spark.createDataFrame([(1, " why "), (2, None), (3, "how")], "query_id int, text string")
    assert {r["query_id"]: r["text"] for r in attachments.search_texts(asked, rows).collect()} == {1: "why " + "x" * 500 + " second text", 2: "", 3: "how"}

    class Told:
        def __call__(self, prompts):
            return [{"Rew": "<think>x</think>rewritten", "Giv": '["one way", "how"]', "Wri": "a passage"}[p[:3]] for p in prompts]

    asked = spark.createDataFrame([(3, "how", "earlier talk"), (4, "what", None)], "query_id int, text string, history string")
    got = [(r["query_id"], r["kind"], r["text"]) for r in models.expand_with_history(asked, Told()).orderBy("query_id", "nth").collect()]
    assert got == [(3, "question", "how"), (3, "rewriting", "rewritten"), (3, "variant", "one way"), (3, "passage", "a passage"), (4, "question", "what"), (4, "variant", "one way"), (4, "variant", "how"), (4, "passage", "a passage")]


def test_reasoning_fences_and_scripts():
    assert models.strip_reasoning("<think>a```x```</think> b ```<think>y</think>``` c") == "b ```<think>y</think>``` c"
    assert models.strip_reasoning(' ["<think>"] ') == '["<think>"] '
    assert models.strip_reasoning("plain thoughts\n\nОтвет да\n\nmore", "Ѐ-ӿ") == "Ответ да\n\nmore"
    state, shown = (False, "", False), ""
    for piece in ("  <thi", "nk>secret</th", "ink> told ", "more"):
        *state, more = streams.shown_part(*state, piece)
        shown += more
    assert shown.endswith("told more") and "secret" not in shown


def test_one_failing_text_is_embedded_alone_or_fails_the_job():
    class Fragile:
        def __call__(self, texts):
            if len(texts) > 1:
                raise RuntimeError("too many")
            return [[1.0]] if texts[0] != "bad" else []

    assert models.vectors_of(Fragile(), ["a", "b"]) == [[1.0], [1.0]]
    with pytest.raises(ValueError, match="nothing is stored"):
        models.vectors_of(Fragile(), ["a", "bad"])


def test_reindex_falls_back_aborts_and_carries_over(spark, tmp_path):
    from quarrystone import store
    from quarrystone.plans.reindex import NothingExtracted, reindex

    root, told = f"file://{tmp_path}/index", []

    def snapshot(rows):
        return spark.createDataFrame([(p, len(t), 1, t, t) for p, t in rows], "path string, size_bytes bigint, mtime bigint, sha256 string, text string")

    def chunk(some):
        told.append(some.count())
        lines = some.filter("text != 'unreadable'").select("path", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
        return lines.withColumn("chunk_id", F.md5(F.concat("path", F.col("chunk_index").cast("string"), "text")))

    def run(rows, **more):
        return reindex(spark, root, snapshot(rows), chunk, models.HashEmbedder(8), **more)

    first = run([("a", "x\ny"), ("b", "z")])
    assert first.full_reason == "manifest_missing" and store.current(spark, root) == first.version
    assert run([("a", "x\ny"), ("b", "z")]).version == first.version  # nothing to do
    with pytest.raises(NothingExtracted):
        run([("a", "unreadable"), ("b", "z")])
    assert store.current(spark, root) == first.version
    told.clear()
    second = run([("a", "x\nnew"), ("c", "c")])
    assert second.full_reason is None and second.counts == {"changed": 1, "deleted": 1, "new": 1} and told == [2]
    chunks = {(r["path"], r["text"]) for r in spark.read.parquet(f"{second.version}/chunks").collect()}
    assert chunks == {("a", "x"), ("a", "new"), ("c", "c")} and spark.read.parquet(f"{second.version}/vectors").count() == 3
    assert spark.read.parquet(f"{first.version}/chunks").count() == 3  # readers of the old version keep it
    assert run([("c", "c")], settings_hash="other").full_reason == "settings_changed" and run([("c", "c")], settings_hash="other", incremental=False).full_reason == "disabled"


def test_chunk_maintenance_can_start_again(spark, tmp_path):
    text = "A sentence that is long enough to be a chunk of its own, surely. "
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/work"

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("doc_id bigint, text string").parquet(source)
        return {(r["doc_id"], r["chunk_index"], r["text"]) for r in streams.maintain_chunks(stream, folder).collect()}

    arrive([(1, text + "one"), (2, text + "two"), (2, text + "zzz")])
    assert {(i, t[-3:]) for i, _, t in run()} == {(1, "one"), (2, "zzz")}
    assert {(i, t[-3:]) for i, _, t in run()} == {(1, "one"), (2, "zzz")}
    arrive([(2, text + "new"), (3, text + "add")])
    assert {(i, t[-3:]) for i, _, t in run()} == {(1, "one"), (2, "new"), (3, "add")}


def test_a_reference_counts_only_with_its_semicolon():
    page = "<title>a &amp;&amp</title><article><h1>a &amp;&amp</h1><p>&lt;b&#62; &c &#x26;</p></article>"
    assert html.page_text(page) == ("a &&amp", "a &&amp <b> &c &")


def test_evaluation_reports_latency(spark, sf_dir):
    from quarrystone.plans import catalogue

    assert "avg_latency_ms" in catalogue.queries()["eval_metrics"](spark, sf_dir).columns
