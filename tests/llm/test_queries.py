"""The registered op queries on whole tables: against their SQL, or against brute force of their contract."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quarrystone.llm import queries, token_counts
from quarrystone.llm.queries import BYTE_TOKENIZER, tokenizer_file, tokenizer_pattern
from test_rows import check_shards, plain_ids


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.project(", ".join(columns)).fetchall()))


def test_op1_packs_all_ids(spark, sf_dir, texts):
    got = queries.op1_packing(spark, sf_dir).collect()
    want = Counter()
    for doc_id, ids in zip(texts, plain_ids([t or "" for t in texts.values()]), strict=True):
        ids = [*ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(places) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_op2_scores_all_and_never_learns_what_is_held_out(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [i for i in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in held) >= 0.9 * len(held)


def test_op7_deals_all_rows(spark, sf_dir, texts):
    got = queries.op7_sharding(spark, sf_dir).collect()
    longest = max(len((t or "").encode()) for t in texts.values()) + 8
    check_shards(list(texts.items()), got, longest)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_op9_edits_by_the_next_document(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, sf_dir).collect()}
    ids = sorted(texts)
    prints = defaultdict(set)
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, more = texts[i] or "", texts[after] or ""
        n = len(text) // 4
        edited, r = text[: len(text) - n] + more[:n], got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints[text].add(r["fingerprint"]), prints[edited].add(r["edited_fingerprint"])
        same = [r["fingerprint"][k : k + 4] == got[after]["fingerprint"][k : k + 4] for k in range(0, len(r["fingerprint"]), 4)]
        assert r["near_next"] == pytest.approx(sum(same) / len(same))
    assert all(len(x) == 1 for x in prints.values())


def test_op10_counts_all_lengths(spark, sf_dir, texts):
    encode = token_counts.encoder(tokenizer_file(BYTE_TOKENIZER), tokenizer_pattern()).encode_ordinary
    lengths = [len(encode(t or "")) for t in texts.values()]
    got = queries.op10_token_counts(spark, sf_dir).collect()
    assert {r["n_tokens"]: r["n_docs"] for r in got} == Counter(lengths)
    assert all(r["truncated_total"] == sum(min(x, r["n_tokens"]) for x in lengths) for r in got)
