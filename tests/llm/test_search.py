"""Collocations, lexical search and license scans against brute force."""

import re
from collections import Counter, defaultdict
from math import floor, log

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cases import awkward_rows, documents, prose
from quarrystone.llm import collocations, lexical_search, license_scan

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, max_words=3, min_count=10, share=50, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= min_count}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * n >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


PHRASE_ROWS = [
    (1, "Of course, the new york times; New York times! new york city " * 6, "en"), (2, "new york times new york\ntimes New  York\ttimes." * 5, None),
    (3, None, None), (4, "", "en"), (5, "a a a a a a a a a a a a a a a a", "en"), (6, "É É É ß ß ß é é é x\x1cy nbsp word " * 5, "fr"), (6, "É É É ß ß ß é é é " * 5, "fr"),
    (7, prose(5, 3000), "de"), (8, prose(5, 3000).upper(), "de"), (None, "left alone, left alone. " * 9, "und"), (9, "x" * 30_000 + " end of it " * 12, "de"),
]


@pytest.fixture(scope="module")
def phrase_docs(spark):
    return spark.createDataFrame(PHRASE_ROWS, "doc_id bigint, text string, lang string").withColumns({c: F.lit(1) for c in ("word", "place", "n", "id", "f", "block", "seq", "rank", "a")})


@pytest.mark.parametrize(("max_words", "block_bytes"), [(3, 10_000_000), (3, 100), (2, 1000), (5, 1000)])
def test_phrases_equal_brute_force(phrase_docs, max_words, block_bytes):
    got = collocations.collocations(phrase_docs, max_words=max_words, block_bytes=block_bytes).collect()
    want = brute_phrases([(t, x) for _, t, x in PHRASE_ROWS], max_words)
    assert sorted(map(tuple, got)) == want and len(want) > 10


def test_only_the_first_phrases_of_a_language_are_given(phrase_docs):
    got = collocations.collocations(phrase_docs, min_count=2, top=7).collect()
    assert sorted(map(tuple, got)) == brute_phrases([(t, x) for _, t, x in PHRASE_ROWS], min_count=2, top=7)


def test_ranking_in_rounds_keeps_the_first(spark):
    rows = spark.range(5000).select(F.lit("en").alias("lang"), (F.col("id") * 7919 % 1000).alias("score"), F.col("id").cast("string").alias("phrase"))
    got = collocations.best_of_each(rows, "lang", [F.desc("score"), F.asc("phrase")], 20, rows_each=100).collect()
    want = sorted((-(i * 7919 % 1000), str(i)) for i in range(5000))[:20]
    assert sorted((r["rank"], -r["score"], r["phrase"]) for r in got) == [(k, *row) for k, row in enumerate(want, 1)]


def test_scores_beyond_64_bits_are_exact(spark):
    a, left, right = 3_000_000_007, 4_000_000_009, 3_999_999_979
    gram = spark.createDataFrame([(1, "en", "p q", a, [left, a], [right, a])], "id long, lang string, phrase string, f long, heads array<long>, tails array<long>")
    assert collocations.scored(gram, 2).first()["score"] == 1_000_000 * a * a // (left * right)


def test_phrases_of_no_documents(phrase_docs):
    assert collocations.collocations(phrase_docs.limit(0)).count() == 0
    assert collocations.collocations(phrase_docs.filter("doc_id = 3")).count() == 0


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_ranking(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, query in asked.items():
        found = []
        for doc_id, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_all
            score = sum(r * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in query.items() if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        out += [(item, k, doc_id, -score) for k, (score, _, doc_id) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "block_terms", "top"), [(4096, 50_000, 20), (3, 40, 20), (5, 1, 2)])
def test_rankings_equal_brute_force(spark, window, block_terms, top):
    docs = awkward_rows() + [(100 + i, prose(i, 5 + 13 * (i % 7))) for i in range(60)] + [(50, "tie w1")] * 3 + [(49, "tie w1"), (-5, "tie w1")]
    items = [(1, prose(1, 20)), (2, None), (3, "  "), (4, "tie, TIE; w1"), (5, "nowhere to be found zz"), (1, "w1 w2"), (None, "one Ünïcode 漢字")]
    got = lexical_search.ranked_documents(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit(1)), top, window, block_terms)
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranking(docs, items, top)


def test_searches_of_nothing(spark):
    none, items = documents(spark, []), spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    assert lexical_search.ranked_documents(none, items).count() == 0
    assert lexical_search.ranked_documents(documents(spark), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_windows_end_early_where_postings_are_many(spark, monkeypatch):
    docs = [(i, prose(i, 50)) for i in range(40)]
    monkeypatch.setattr(lexical_search, "WINDOW_BYTES", 1)
    items = [(1, prose(3, 30))]
    got = lexical_search.ranked_documents(documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranking(docs, items)


def words_joined(text):
    words = license_scan.words_of(text)
    return " ".join(["", *words, ""]) if words else ""


LICENSE_ROWS = [
    (1, None), (2, ""), (3, "MIT License"), (4, "the MIT\nLICENSE and the mit-license; Apache License, Version 2.0"), (5, "mit licenses"), (6, "submit license"),
    (7, "Released under the MIT License. Licensed under the Apache License, Version 2.0."), (7, "Released under the terms of the MIT License."), (8, "This work is licensed under the GNU General Public License, version 3."),
    (9, "licensed under the GNU General Public License version 2"), (10, "Licensed under CC BY-NC 4.0."), (11, "licensed under a the creative commons cc by nc 4 0 international"), (12, "licensed under the a cc by nc 4 0"),
    (None, "general public license " * 2000 + "mit license"), (13, "Ünï mit license é"), (14, "mit mit license license"),
]


def test_license_scans_equal_brute_force(spark):
    rows = LICENSE_ROWS + [(None if i is None else 100 + i, t) for i, t in awkward_rows()]
    got = license_scan.scan(documents(spark, rows)).collect()
    want = []
    for i, text in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        hits = [(at, label) for phrase, label in license_scan.PHRASES.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        base, told = {label for _, label in hits}, " ".join(["", *words, ""])
        found = {label for label, t in license_scan.TEMPLATES.items() if re.search(license_scan.template_pattern(t), told)}
        places = [at for at, _ in hits]
        score = 1.0 if found else 0.5 if base else 0.0
        want.append((i, len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[10] == labels[11] == "cc-by-nc-4.0" and labels[12] == "" and labels[9] == "gpl" and labels[8] == "gpl,gpl-3.0"
    assert license_scan.scan(documents(spark, [])).count() == 0


def test_every_template_accepts_its_own_wording_and_no_changed_one():
    for template in license_scan.TEMPLATES.values():
        machine = license_scan.Automaton(template)

        def filled(parts, optional):
            out = []
            for part in parts:
                out += [part] if isinstance(part, str) else (filled(part, optional) if optional else []) if isinstance(part, list) else ["any"] * (part[0] or int(optional))
            return out

        for optional in (False, True):
            words = filled(license_scan.regions(template), optional)
            assert machine.accepts(["x", *words, "y"])
            must = filled(license_scan.regions(template), False)
            for at in range(len(must)):
                assert must[at] == "any" or not machine.accepts(must[:at] + must[at + 1 :]) or must[at] in must[at + 1 : at + 2] or must[at - 1 : at] == [must[at]]


MARKED = st.recursive(st.sampled_from(["a ", "b ", "c ", "<<var;match=.{0,2}>> ", "<<var;match=.{1,3}>> ", "<<var;match=.+>> ", "<<var;match=.*>> "]), lambda inner: st.lists(inner, min_size=1, max_size=3).map(lambda x: f"<<beginOptional>>{''.join(x)}<<endOptional>>"), max_leaves=5)


@given(st.lists(MARKED, max_size=6), st.lists(st.sampled_from("abcd"), max_size=9))
@settings(max_examples=300, deadline=None)
def test_automata_accept_what_the_pattern_does(parts, words):
    template = "".join(parts[:3]) + " a " + "".join(parts[3:])
    want = re.search(license_scan.template_pattern(template), " ".join(["", *words, ""]) if words else "")
    assert license_scan.Automaton(template).accepts(words) == bool(want)


@pytest.mark.parametrize("template", ["a <<beginOptional>> b", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>", "a <<var;name=x>>", "<<var;match=.{1,2}>>"])
def test_faulty_templates_are_refused(template):
    with pytest.raises(ValueError):
        license_scan.Automaton(template)
