"""Functions and writers that no registered query runs alone, on the fixtures' cases."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrystone import store
from quarrystone.config import Settings
from quarrystone.functions import html, models
from quarrystone.functions import text as T
from quarrystone.operators import history_store, quality_reports
from quarrystone.operators import history_writes as W
from quarrystone.plans import answering, retrieval
from quarrystone.sources import files, pages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [('a<b>:"c', "a_b_c"), ("  .x. ", "x"), ("con", "_con"), ("", "_"), ("...", "_"), ("ok name", "ok name")])
def test_file_name_parts(spark, name, want):
    assert one(spark, T.clean_component(F.lit(name))) == want


def test_long_file_name_parts_end_in_a_hash(spark):
    got = one(spark, T.clean_component(F.lit("x" * 100)))
    assert len(got) == 80 and got.startswith("x" * 71 + "_") and got != one(spark, T.clean_component(F.lit("x" * 101)))


def test_paths_braces_and_controls(spark):
    assert one(spark, T.normal_path(F.lit("\\\\a\\b/c"))) == "a/b/c"
    assert one(spark, T.json_object(F.lit('say {"a": {"b": 1}} now'))) == '{"a": {"b": 1}}' and one(spark, T.json_object(F.lit("none"))) == ""
    assert one(spark, T.json_object(F.lit(' {"a": 1} '))) == '{"a": 1}' and one(spark, T.json_object(F.lit("{broken"))) == "" == one(spark, T.json_object(F.lit("a {b} c")))
    assert one(spark, T.without_controls(F.lit("a\x00b\tc\n\x7f"))) == "ab\tc\n"


@pytest.mark.parametrize(("url", "want"), [("HTTP://A.x//bin//view/P/?q=1#f", "http://a.x/bin/view/P"), ("http://b.x/bin/view/P", None), ("http://a.x/other", None), ("/bin/view/P", None)])
def test_addresses_of_one_site(spark, url, want):
    assert one(spark, T.view_url(F.lit(url), F.lit("http://a.x/start"), "/bin/view/")) == want


def test_wiki_content_without_an_article():
    page = "<body><p>menu</p><div id='xwikicontent'><p>told</p></div></body>"
    assert html.page_text(page)[1] == "told" and html.page_text(page.replace("<p>told</p>", "<article>more</article>"))[1] == "more"


def test_settings_have_bounds_and_lists():
    assert Settings().from_text({"extensions": "md, , txt"}).extensions == ("md", "txt")
    assert Settings().from_text({"top_k": "100", "min_score": "1"}).top_k == 100
    for bad in ({"top_k": "0"}, {"top_k": "101"}, {"min_score": "1.5"}, {"chunk_size": "10"}):
        with pytest.raises(ValueError, match="is not between"):
            Settings().from_text(bad)


@pytest.mark.parametrize(("asked", "want"), [(None, 30), (0, 30), (-5, 1), (7, 7), (900, 365)])
def test_overviews_cover_a_bounded_time(spark, asked, want):
    assert one(spark, quality_reports.overview_days(asked)) == want


def test_logs_are_appended_and_read_again(spark, tmp_path):
    for n in range(2):
        files.append_log(spark.createDataFrame([(f"q{n}", "answer"), (f"r{n}", "rewrite")], "question string, stage string"), f"file://{tmp_path}/log")
    got = files.read_json_lines(spark, f"file://{tmp_path}/log/stage=answer", "question string").collect()
    assert sorted(r["question"] for r in got) == ["q0", "q1"]


def test_json_lines_are_written_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([("q", None), ("r\n", 2)], "question string, n bigint")
    files.write_json_lines(rows, f"file://{tmp_path}/out")
    assert sorted(map(tuple, files.read_json_lines(spark, f"file://{tmp_path}/out", "question string, n bigint").collect()), key=str) == [("q", None), ("r\n", 2)]


def test_history_tables_are_kept_by_versions(spark, tmp_path):
    root = f"file://{tmp_path}/history"
    none = history_store.read(spark, root)
    assert {name: table.count() for name, table in none.items()} == {"users": 0, "sessions": 0, "messages": 0, "feedback": 0} and none["users"].columns[0] == "user_id"
    old = spark.createDataFrame([(1, "x@y")], "user_id bigint, email string")  # a table of an older version
    assert history_store.write(spark, root, {"users": old}) == 1
    first = history_store.read(spark, root)
    votes = spark.createDataFrame([(1, 2, 3, "up", None, None)], W.FEEDBACK)
    assert history_store.write(spark, root, {"feedback": votes}, after=1) == 2
    now = history_store.read(spark, root)
    assert now["users"].first()["email"] == "x@y" and now["users"].first()["role"] is None and now["feedback"].count() == 1 and first["feedback"].count() == 0
    with pytest.raises(store.Conflict):
        history_store.write(spark, root, {"users": old.limit(0)}, after=1)
    assert history_store.read(spark, root)["users"].count() == 1


def test_users_and_their_roles(spark):
    schema = "user_id bigint, email string, username string, role string"
    users = spark.createDataFrame([(1, "a@x", "Ann", "user"), (2, None, "Bob", "admin")], schema)
    new = spark.createDataFrame([(1, "z@x", "Zoe", "user"), (3, "A@X ", "Cy", "user"), (4, "d@x", "bob", "user"), (6, "e@x", "Eve", "user"), (5, "E@x", "Ida", "user"), (7, None, "Jo", "user")], schema)
    after = W.add_users(users, new)
    assert sorted(r["user_id"] for r in after.collect()) == [1, 2, 5, 7]
    asked = spark.createDataFrame([("BOB",), (" a@X",), ("nobody",)], "name string")
    assert {(r["name"], r["user_id"]) for r in W.find_users(after, asked).collect()} == {("BOB", 2), (" a@X", 1)}
    roles = W.set_roles(after, spark.createDataFrame([(1, "admin"), (9, "admin"), (2, "editor"), (2, "user")], "user_id bigint, role string"))
    assert {r["user_id"]: r["role"] for r in roles.collect()} == {1: "admin", 2: "user", 5: "user", 7: "user"}
    old = spark.createDataFrame([(1, "x", 5)], "user_id int, email string, gone int")
    assert W.with_schema(old, W.USERS).columns == ["user_id", "email", "username", "role", "created_at"]


def test_sessions_are_renamed(spark):
    sessions = spark.createDataFrame([(1, None, "old", 1, 5), (2, None, "kept", 1, 5)], "session_id bigint, user_id bigint, title string, created_at int, updated_at int")
    changes = spark.createDataFrame([(1, "first", 6), (1, "second", 9), (2, "  ", 9), (3, "x", 9)], "session_id bigint, new_title string, at int")
    assert {r["session_id"]: (r["title"], r["updated_at"]) for r in W.rename_sessions(sessions, changes).collect()} == {1: ("second", 9), 2: ("kept", 5)}


def test_each_question_is_searched_in_its_own_way(spark):
    asked = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", None)], "query_id bigint, text string, deep boolean")
    mark = lambda way: lambda some: some.select("query_id", F.lit(way).alias("way"))
    told = lambda **o: {r["query_id"]: (r["way"], r["deep"]) for r in retrieval.retrieve_auto(mark("plain"), mark("deep"), asked, **o).collect()}
    assert told() == {1: ("deep", True), 2: ("plain", False), 3: ("plain", False)} and told(deep_by_default=True)[3] == ("deep", True)


FOUND = "query_id bigint, doc_id bigint, text string, source string, title string, score double, position int"


def found_rows(spark):
    return spark.createDataFrame([(1, 7, "The fox sleeps in the warm den. It is red.", "a.txt", "A", 0.9, 1), (1, 8, "Birds sing early in the morning.", None, "B", 0.456, 2)], FOUND)


def test_answers_with_verdicts_and_further_questions(spark):
    asked = spark.createDataFrame([(1, "what does the fox do"), (2, "nothing found")], "query_id bigint, text string")
    got = {r["query_id"]: r for r in answering.answer(found_rows(spark), asked, answering.TemplateGenerator(), judged=True, further=2).collect()}
    assert got[1]["answer"].startswith("The fox sleeps") and got[1]["n_sources"] == 2 and got[1]["verdict"] == "supported" and len(got[1]["follow_ups"]) == 2
    assert got[2]["verdict"] == "no_sources" and got[2]["n_sources"] == 0

    class Odd:
        def __call__(self, prompts):
            return ['{"verdict": 5' if p.startswith("Is this") else '["long question ' + "x" * 200 + '", "short one", "short one"]' for p in prompts]

    answers = spark.createDataFrame([(1, "it sleeps")], "query_id bigint, answer string")
    cited = spark.createDataFrame([(1, 1, "The fox sleeps")], "query_id bigint, position int, citation string")
    assert answering.verdicts(answers, cited, Odd()).first()["verdict"] == "partial"
    assert [(r["nth"], len(r["question"])) for r in answering.follow_ups(answers, Odd()).orderBy("nth").collect()] == [(0, 120), (1, 9)]


@pytest.mark.parametrize("mode", [*answering.MODES, "unknown"])
def test_prompts_of_every_mode(spark, mode):
    packed = spark.createDataFrame([(1, 1, "[a]\nfox\n", False)], "query_id bigint, position int, block string, truncated boolean")
    asked = spark.createDataFrame([(1, "why"), (2, "how")], "query_id bigint, text string")
    past = spark.createDataFrame([(1, "User: hi")], "query_id bigint, history string")
    got = {r["query_id"]: r["prompt"] for r in answering.prompts(packed, asked, mode, past).collect()}
    head = answering.MODES.get(mode, answering.MODES["default"])
    assert got[1].startswith(f"{head}\n\nConversation so far:\nUser: hi\n\n") and "fox" in got[1] and got[1].endswith("Question: why")
    assert got[2] == f"{head}\n\n(no passages were found)\n\nQuestion: how"


def test_results_as_a_reader_takes_them(spark):
    found = found_rows(spark)
    answers = spark.createDataFrame([(1, "it sleeps"), (2, "nothing")], "query_id bigint, answer string")
    cited = spark.createDataFrame([(1, 1, "The fox sleeps", "a.txt", 0.9)], "query_id bigint, position int, citation string, label string, score double")
    got = {r["query_id"]: r for r in answering.results(answers, found, cited).collect()}
    assert [(s["title"], s["source"], s["path"], s["relevance"], s["section_path"]) for s in got[1]["sources"]] == [("A", "a.txt", "N/A", 0.9, ""), ("B", "B", "N/A", 0.46, "")]
    assert [c.asDict() for c in got[1]["citations"]] == [{"text": "The fox sleeps", "source": "a.txt", "chunk_id": None, "score": 0.9}]
    assert got[2]["sources"] == [] and got[2]["citations"] == []


def test_slow_and_failing_rerankers_leave_a_record(spark):
    class Model:
        def __call__(self, query, texts):
            if query == "slow":
                time.sleep(5)
            if query == "bad":
                raise ValueError("no model")
            return [float("fox" in t) for t in texts] if query != "short" else [1.0]

    asked = spark.createDataFrame([(1, "fine"), (2, "slow"), (3, "bad"), (4, "short")], "query_id bigint, text string")
    found = spark.createDataFrame([(q, d, t, 0.5, p) for q in range(1, 5) for d, t, p in ((7, None, 1), (8, "a fox", 2))], "query_id bigint, doc_id bigint, text string, score double, position int")
    got = {}
    for r in models.rerank(found, asked, Model(), seconds=1.0).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["degraded"]))
    assert got == {1: [(8, None), (7, None)], 2: [(7, "timeout"), (8, "timeout")], 3: [(7, "ValueError: no model"), (8, "ValueError: no model")], 4: [(7, "ValueError: 1 scores for 2 texts"), (8, "ValueError: 1 scores for 2 texts")]}


def test_marked_passages_are_no_list():
    assert models.strip_reasoning("[1] <think>x</think> and [2]") == "[1]  and [2]"
    assert models.strip_reasoning(' ["<think>x</think>"]') == '["<think>x</think>"]'


def package(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as held:
        for name, text in members.items():
            held.writestr(name, text)
    return out.getvalue()


def test_sheets_go_by_their_relationships():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = lambda t: f"<worksheet {s}><sheetData><row><c t='inlineStr'><is><t>{t}</t></is></c></row></sheetData></worksheet>"
    members = {
        "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="Moved" r:id="rId7"/><sheet name="Old" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId2" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": sheet("one"),
        "xl/worksheets/sheet2.xml": sheet("two"),
    }
    assert files.read_xlsx(package(members), "x")[1] == "Sheet: Moved two Sheet: Old one"
    del members["xl/_rels/workbook.xml.rels"]
    assert files.read_xlsx(package(members), "x")[1] == "Sheet: Moved one Sheet: Old two"


def test_archives_tell_what_they_could_not_read(spark):
    good, broken = package({"a.txt": "hello " * 50}), b"PK no archive"
    damaged = bytearray(package({"b.txt": "x" * 100}))
    damaged[40:60] = b"\0" * 20
    rows = spark.createDataFrame([("g", bytearray(good)), ("b", bytearray(broken)), ("d", damaged), ("n", None)], "path string, content binary")
    got = {r["path"]: r for r in files.archive_members(rows).collect()}
    assert got["g"]["error"] is None and bytes(got["g"]["content"]).startswith(b"hello")
    assert all(got[p]["content"] is None and got[p]["error"] for p in "bdn")
    assert files.archive_members(rows.filter("path = 'g'"), largest=10).first()["error"] == "300 bytes are more than 10"


def test_links_of_one_site(spark):
    df = spark.createDataFrame([(1, "http://a.x/p", "<a href='/t/1'>x</a><a href='http://b.x/t/2'>y</a><a href='/u'>z</a>")], "page_id bigint, url string, html string")
    assert [r["target"] for r in pages.links(df, same_host=True, prefix="/t").collect()] == ["http://a.x/t/1"]


def test_crawls_jump_over_long_chains(spark, monkeypatch):
    n = 150
    rows = [(i, f"http://a.x/{i:03}", f'<a href="/{i + 1:03}">next</a>') for i in range(n)]
    rows += [(900, "http://a.x/900", '<a href="/005">in</a><a href="/901">out</a>'), (901, "http://a.x/901", '<a href="/902">x</a>'), (902, "http://a.x/902", '<a href="/901">back</a>')]
    rows[40] = (40, "http://a.x/040", '<a href="/041">next</a><a href="/120">far</a><a href="/900">side</a>')
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {f"http://a.x/{i:03}": i if i < 120 else min(i, 41 + i - 120) for i in range(n)} | {"http://a.x/900": 41, "http://a.x/901": 42, "http://a.x/902": 43}
    want |= {f"http://a.x/{i:03}": min(want[f"http://a.x/{i:03}"], 42 + i - 5) for i in range(5, n)}
    steps, plain = [], pages._by_jumps
    monkeypatch.setattr(pages, "_by_jumps", lambda *a: steps.append(1) or plain(*a))
    got = pages.crawl_order(df)
    assert {r["url"]: r["depth"] for r in got.collect()} == want and steps
    assert {r["depth"] for r in pages.crawl_order(df, max_depth=10).collect()} == {None, *range(10)}
