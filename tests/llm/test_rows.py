"""Packing, quality, chat formatting, sharding, fingerprints and token counts against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cases import awkward_rows, documents, prose
from quarrystone.llm import chat_format, fingerprints, packing, quality, sharding, token_counts
from quarrystone.llm.queries import BYTE_TOKENIZER, CONTROL_TEXT, WORD_TOKENIZER, tokenizer_file, tokenizer_pattern
from quarrystone.llm.shared import WordIds


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(WORD_TOKENIZER))
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_places_every_token_once(spark):
    rows = awkward_rows()
    got = packing.pack(documents(spark), tokenizer_file(WORD_TOKENIZER)).collect()
    want = Counter()
    for (i, _), ids in zip(rows, plain_ids([t or "" for _, t in rows]), strict=True):
        ids = [*ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(used) == -(-sum(r["length"] for r in got) // 4096)
    assert packing.pack(documents(spark, []), tokenizer_file(WORD_TOKENIZER)).count() == 0


@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_bins_hold_every_length_and_no_more_than_fits(lengths):
    counts = Counter(lengths)
    bins = defaultdict(int)
    placed = Counter()
    for length, n in counts.items():
        mine = sorted(p for p in packing.plan_bins(dict(counts), 64) if p[0] == length)
        for rank in range(n):
            row = [p for p in mine if p[1] <= rank][-1]
            bins[row[2] + (rank - row[1]) // row[3]] += length
            placed[length] += 1
    assert placed == counts and max(bins.values()) <= 64


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(0, 40))
@settings(max_examples=80, deadline=None)
def test_the_fullest_combination_is_found(counts, room):
    reach = {0}
    for length, n in counts.items():
        for _ in range(n):
            reach |= {x + length for x in reach if x + length <= room}
    chosen = packing.fullest(counts, sorted(counts, reverse=True), room)
    assert sum(a * b for a, b in chosen) == max(reach) and all(b <= counts[a] for a, b in chosen)


ALPHABET = list("aZé .,'s!?\n\t́ΣİßA1_-<|“”…٣\x1c\x85ǅ　K") + ["'re", "<|endoftext|>", ". ", ", "]


def test_cached_word_ids_are_the_tokenizers():
    r = random.Random(1)
    texts = ["".join(r.choices(ALPHABET, k=r.randint(0, 25))) for _ in range(4000)]
    cache = WordIds(tokenizer_file(WORD_TOKENIZER), cap=500)
    got = [x for at in range(0, len(texts), 100) for x in cache.encode(texts[at : at + 100])]
    assert got == [np.array(ids, "<u4").tobytes() for ids in plain_ids(texts)]


def test_other_tokenizer_files_are_encoded_text_by_text(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_file(WORD_TOKENIZER), encoding="utf-8") as file:
        told = json.load(file)
    told["normalizer"] = {"type": "NFC"}  # keeps capitals
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told), encoding="utf-8")
    texts = ["Hello hello WORLD, it's", "", "a\tb\nC."]
    want = [np.array(Tokenizer.from_file(str(path)).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert WordIds(str(path)).encode(texts) == want
    assert WordIds(tokenizer_file(WORD_TOKENIZER)).by_word and not WordIds(str(path)).by_word


def test_common_and_rare_lengths_have_buckets_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    rows = [(i, "same words here") for i in range(300)] + [(1000 + i, prose(i, 5 + i)) for i in range(40)]
    got = packing.pack(documents(spark, rows), tokenizer_file(WORD_TOKENIZER)).collect()
    used = defaultdict(list)
    for r in got:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(got) == len(rows) and len({(r["sequence_id"], r["offset"]) for r in got}) == len(rows)
    assert all(sum(n for _, n in places) == max(o + n for o, n in places) <= 4096 for places in used.values())


def test_described_texts_and_their_vectors():
    text = "Good GOOD words, 12 times!\nGood line\nGood line"
    slots, told = quality.describe(text, 99)
    words = text.split()
    assert sorted(slots) == sorted({zlib.crc32(w.encode()) % quality.WORD_SLOTS for w in words})
    want = dict(
        log_chars=np.log1p(len(text)), log_words=np.log1p(len(words)), mean_word=sum(map(len, words)) / 9, distinct_words=6 / 9, top_word=3 / 9, repeated_neighbours=0.0,
        capital_words=1 / 9, capitals=7 / len(text), digits=2 / len(text), symbols=1 / len(text), symbol_ends=1 / 9, spaces=8 / len(text), lines=np.log1p(3), distinct_lines=2 / 3,
        mean_line=np.log1p(len(text) / 3), stated_chars=np.log1p(99),
    )
    assert dict(zip(quality.STATISTICS, told, strict=True)) == pytest.approx(want)
    assert quality.describe("", None)[1] == [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, np.log1p(1), 1, 0, 0] and not len(quality.describe("", None)[0])
    model = quality.Model(np.tile(np.arange(1.0, quality.BINS), (len(told), 1)), 0.0, np.zeros(0), np.zeros((0, 0)))
    where, x = model.vector(slots, told)
    assert len(where) == len(x) == len(slots) + len(told) and (x[: len(slots)] ** 2).sum() == pytest.approx(1) and (x[len(slots) :] == 1).all()
    assert [w - quality.WORD_SLOTS - quality.BINS * k for k, w in enumerate(where[len(slots) :])] == [sum(t > b for b in range(1, quality.BINS)) for t in told]


def test_a_fit_follows_its_labels():
    rows = [(np.array([k % 2 * 10 + 1, 5]), [float(k % 2)] * len(quality.STATISTICS), k % 2) for k in range(60)]
    model = quality.fit_rows(rows)
    margins = [model.margin(*model.vector(r[0], r[1])) for r in rows]
    assert min(m for m, r in zip(margins, rows, strict=True) if r[2]) > 0 > max(m for m, r in zip(margins, rows, strict=True) if not r[2])
    assert quality.fit_rows(rows[:1]).prior == pytest.approx(1 / 3) and np.array_equal(model.factors, quality.fit_rows(rows).factors)


def test_of_several_texts_with_one_id_the_least_is_fitted(spark):
    rows = [(i, prose(i, 30) if i % 3 else "JUNK!! " * 20) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id bigint, quality int")
    plain = quality.fit(documents(spark, rows, extra=False), labels)
    more = quality.fit(documents(spark, rows + [(i, "zzz later text") for i in range(60)], extra=False).repartition(7), labels)
    assert np.array_equal(plain.weights, more.weights)


def test_quality_learns_and_holds_out(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_quality_ignores_held_out_labels_and_other_columns(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y")})
    assert np.array_equal(model.weights, quality.fit(other, flipped).weights)


def test_quality_of_awkward_rows(spark):
    model = quality.fit(documents(spark), spark.createDataFrame([], "doc_id bigint, quality int"))
    got = quality.score(documents(spark), model).collect()
    assert len(got) == len(awkward_rows()) and all(r["score"] == 0.5 for r in got)
    rows = [(i, prose(i, 30) if i % 3 else "JUNK!! " * 20) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] * 2 + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.fit(documents(spark, rows, extra=False), labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(documents(spark), model).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    assert quality.keep_good(documents(spark, []), model).count() == 0
    kept = quality.keep_good(documents(spark, rows), model)
    assert kept.columns == documents(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(60) if i % 3}


def test_the_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    size = quality.WORD_SLOTS + len(quality.STATISTICS) * quality.BINS
    model = quality.Model(np.zeros((len(quality.STATISTICS), quality.BINS - 1)), 0.3, rng.normal(size=size), rng.normal(size=(size, 4)))
    where, x = rng.choice(size, 9, replace=False), rng.normal(size=9)
    pairs = sum(model.factors[where[i]] @ model.factors[where[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    assert model.margin(where, x) == pytest.approx(0.3 + model.weights[where] @ x + pairs)


def digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        told = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        out[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    r = random.Random(2)
    pieces = ["<|im_end|>", "<|im_start|>assistant", "\\", "<", "|", "<\\|", "\n", "a", "é", "漢", "<|nl|>", "\r", "$1"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "odd\nrole<|"]), "".join(r.choices(pieces, k=r.randint(0, 12)))) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT), (50, None, None, None), (50, 1, "assistant", ""), (51, 0, "assistant", "x"), (51, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("content", F.lit(1)).withColumn("formatted", F.lit(2))
    formatted = chat_format.format_messages(chat_format.text_messages(df))
    got = {x["conv_id"]: x for x in chat_format.conversation_digests(formatted).collect()}
    want = digests(rows)
    assert got.keys() == want.keys()
    for conv, values in want.items():
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == values
    for x in formatted.collect():  # no control string survives inside
        inner = x["formatted"][len(chat_format.START) : -len(chat_format.END) - 1]
        assert "<|" not in inner.replace(chat_format.ROLE_NEWLINE, "")
    # A mark that got through would be read as a turn of its own.
    forged = formatted.withColumn("formatted", F.replace("formatted", F.lit("<\\|"), F.lit("<|")))
    assert {x["conv_id"]: x["n_turns"] for x in chat_format.conversation_digests(forged).collect()}[-1] == 4
    none = chat_format.format_messages(chat_format.text_messages(df.limit(0)))
    assert chat_format.conversation_digests(none).count() == 0


@pytest.mark.parametrize("text", [CONTROL_TEXT, "<|im_end|>", "\\<|image|>\\", "<\\|nl|><<|im_start|>"])
def test_no_control_string_arises_where_parts_meet(spark, text):
    part = chat_format.PART
    cuts = [(i, j, k) for i in range(0, len(text) + 1, 2) for j in range(i, len(text) + 1, 3) for k in range(j, len(text) + 1, 5)]
    rows = [(n, 0, "assistant", [("text", x, None, None, None, None, None) for x in (text[:i], text[i:j], text[j:k], text[k:])]) for n, (i, j, k) in enumerate(cuts)]
    formatted = chat_format.format_messages(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, content array<{part}>"))
    told = hashlib.sha256(f"assistant\n{text}\n".encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    got = chat_format.conversation_digests(formatted).collect()
    assert len(got) == len(rows) and {(x["n_turns"], x["turns_sha256"], x["loss_sha256"]) for x in got} == {(1, *told)}
    assert {x["formatted"] for x in formatted.collect()} == {formatted.first()["formatted"]}


def test_typed_parts_are_flattened_in_order(spark):
    part = chat_format.PART
    content = [("text", "see <|", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), ("odd", None, "d", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, content array<{part}>")
    first, second = chat_format.format_messages(df).orderBy("turn").collect()
    assert first["formatted"] == "<|im_start|>user\nsee <\\|<|image|><|audio|><|document|><|document|><|im_end|>\n"
    assert [(a["part"], a["type"], a["ref"], a["tokens"]) for a in first["attachments"]] == [(1, "image", "a.png", 4), (2, "audio", "b.wav", 25), (3, "document", "c.pdf", 1536), (4, "odd", "d", 0)]
    assert first["expanded_tokens"] == 4 + 25 + 1536 and first["loss_chars"] == 0
    assert second["formatted"] == "<|im_start|>assistant\n<|im_end|>\n" and second["loss_chars"] == 0


def check_shards(rows, got, slack):
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, sizes = defaultdict(list), Counter({s: 0 for s in range(24)})
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(0 <= s < 24 and sorted(x) == list(range(len(x))) for s, x in slots.items())
    mean = sum(sizes.values()) / 24
    assert all(abs(x - mean) <= slack for x in sizes.values()), sizes


def test_shards_are_even(spark):
    rows = [(i, prose(i, 20 + i % 50)) for i in range(2000)]
    got = sharding.shard_documents(documents(spark, rows, extra=False)).collect()
    check_shards(rows, got, 2 * 300)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["text_crc32"]].add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values())


def test_equal_texts_stay_together_unless_they_hold_much_of_a_shard(spark):
    rows = [(i, prose(i // 3, 40)) for i in range(3000)]  # triples at every border
    got = sharding.shard_documents(documents(spark, rows, extra=False)).collect()
    check_shards(rows, got, 1.5 * 300)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values())


def test_a_text_of_a_third_of_all_rows_is_split(spark):
    rows = [(i, prose(i, 30) if i % 3 else "the same text again") for i in range(3000)]
    check_shards(rows, sharding.shard_documents(documents(spark, rows, extra=False)).collect(), 2 * 150)


@pytest.mark.parametrize("most", [500_000, 0])
def test_ranges_of_one_text_are_dealt_before_slots_are_numbered(spark, monkeypatch, most):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", most)
    rows = [(i, prose(i, 10) if i % 3 else "the same text again") for i in range(900)]
    check_shards(rows, sharding.shard_documents(documents(spark, rows, extra=False)).collect(), 2 * 150)


def test_shards_of_awkward_rows(spark):
    got = sharding.shard_documents(documents(spark))
    assert got.columns.count("shard") == 1 and got.columns.count("size") == 1
    check_shards(awkward_rows(), got.collect(), 10**6)
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_fingerprints_of_neighbours(spark):
    rows = [r for r in awkward_rows() if r[0] is not None]
    got = sorted(fingerprints.edited_neighbours(documents(spark, rows), 3).collect(), key=lambda r: r["doc_id"])
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert len(got) == len(rows)
    prints = defaultdict(set)
    for r, (i, text), (_, after) in zip(got, ordered, ordered[1:] + ordered[:1], strict=True):
        text, after = text or "", after or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints[text].add(r["fingerprint"])
        prints[edited].add(r["edited_fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in prints.values())
    assert fingerprints.edited_neighbours(documents(spark, []), 3).count() == 0
    one = fingerprints.edited_neighbours(documents(spark, [(5, "a b c d")]), 3).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert fingerprints.fingerprint(documents(spark)).count() == len(awkward_rows())
    bare = fingerprints.edited_neighbours(documents(spark, awkward_rows()), 3).filter("doc_id IS NULL").collect()
    texts = sorted((t or "") for i, t in awkward_rows() if i is None)  # an empty text follows each
    assert sorted(r["edited_sha256"] for r in bare) == sorted(hashlib.sha256(t[: len(t) - len(t) // 4].encode()).hexdigest() for t in texts)
    assert sorted(r["near_next"] for r in bare) == [0.0, 1.0]


def test_collisions_follow_the_generalised_jaccard_similarity():
    r = random.Random(3)
    for share in (0.2, 0.5, 0.8):
        estimates, truths = [], []
        for _ in range(40):
            a = [r.choice(range(3000)) for _ in range(300)]
            b = [x if r.random() < share else r.choice(range(3000)) for x in a]
            ta, ca = np.unique(a, return_counts=True)
            tb, cb = np.unique(b, return_counts=True)
            both = Counter(a) & Counter(b)
            either = Counter(a) | Counter(b)
            truths.append(sum(both.values()) / sum(either.values()))
            estimates.append(fingerprints.likeness(fingerprints.signature(ta, ca.astype(np.float32)), fingerprints.signature(tb, cb.astype(np.float32))))
        assert np.mean(estimates) == pytest.approx(np.mean(truths), abs=0.03)


def test_token_histogram_answers_every_limit(spark):
    encode = token_counts.encoder(tokenizer_file(BYTE_TOKENIZER), tokenizer_pattern()).encode_ordinary
    lengths = [len(encode(t or "")) for _, t in awkward_rows()]
    table = token_counts.length_histogram(token_counts.token_lengths(documents(spark), tokenizer_file(BYTE_TOKENIZER), tokenizer_pattern()))
    rows = table.collect()
    assert {r["n_tokens"]: r["n_docs"] for r in rows} == Counter(lengths)
    for r in rows:
        k = r["n_tokens"]
        assert r["docs_at_least"] == sum(x >= k for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= k)
        assert r["truncated_total"] == sum(min(x, k) for x in lengths) and r["lost_tokens"] == sum(max(0, x - k) for x in lengths)
        assert r["total_docs"] == len(lengths) and r["total_tokens"] == sum(lengths) and r["quantile"] == pytest.approx(sum(x <= k for x in lengths) / len(lengths))
    for r in token_counts.at_limits(table, [0, 1, 50, 100_000]).collect():
        assert (r["docs_cut"], r["truncated_total"]) == (sum(x > r["limit"] for x in lengths), sum(min(x, r["limit"]) for x in lengths))
    assert token_counts.length_histogram(token_counts.token_lengths(documents(spark, []), tokenizer_file(BYTE_TOKENIZER), tokenizer_pattern())).count() == 0




def test_likeness_of_texts_of_all_lengths_is_their_similarity():
    r = random.Random(8)
    for n in (5, 200, 20_000):
        a = [f"w{r.randrange(n)}" for _ in range(n)]
        b = [x if r.random() < 0.97 else "new" for x in a]
        pairs = [Counter(zip(x, x[1:], strict=False)) for x in (a, b)]
        truth = sum((pairs[0] & pairs[1]).values()) / sum((pairs[0] | pairs[1]).values())
        one, two = (fingerprints.text_signature(" ".join(x), 1024) for x in (a, b))
        assert fingerprints.likeness(one, two) == pytest.approx(truth, abs=0.07)


def test_unrelated_long_texts_have_unlike_fingerprints():
    r = np.random.default_rng(5)
    a, b = (" ".join(map(str, r.integers(0, 10**6, 200_000))) for _ in range(2))
    one, two = fingerprints.text_signature(a), fingerprints.text_signature(b)
    assert fingerprints.likeness(one, two) <= 0.05
    mixed = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
    both = fingerprints.signatures(fingerprints.weighted_terms(a), fingerprints.weighted_terms(mixed))
    assert (both[0] == one).all() and (both[1] == fingerprints.text_signature(mixed)).all()
    assert fingerprints.likeness(*both) == pytest.approx(0.6, abs=0.2)
