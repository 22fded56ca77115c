"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Every text becomes a set of hashed word shingles, a MinHash signature (one byte a position is kept) and band hashes.  The
   number of bands follows from the threshold and the miss probability.
2. Equal word sequences meet by digest; one representative each goes on.
3. Representatives that share a band are candidates.  Their signatures are compared batch by batch; a pair is pruned as soon as
   the posterior probability of reaching the threshold falls below the miss probability.  Only a spanning forest of the
   survivors leaves a task.
4. Connected survivors are candidate clusters.  Each cluster is verified where its texts meet: pairs that pass the same
   Bayesian test, the likeliest of a piece first, are checked exactly on their full shingle sets, unless verified links already join them.
5. Components of the verified links are the classes.

In steps 3 and 4 a group of one chunk (``BLOCK_DOCS`` texts) is compared in one task.  A larger one is dealt into chunks, each of
which first meets the same few pivots: rows and texts move once, and most of a group of near copies is joined by that.  In step 3 signatures
that are then not joined with the group's largest part go on, in blocks that meet every chunk.  In step 4 a group whose rows that pivots left apart
share few bands moves no more texts for that: such rows meet by the bands, their signatures are compared, and only pairs that pass the
Bayesian test fetch their texts.  Where the pairs would be more than the rows that blocks move, they meet in blocks too.  So about as many
texts are moved as by the cheaper of both ways.

No step writes all pairs of a group, and every link between different texts is either verified or implied by verified links.

Defined results: a null text is an empty text; a text without words has an empty set and is linked with nothing; a text with
fewer words than a shingle has its whole sequence as one shingle; a null doc_id is never linked and is kept; rows that share a
doc_id are one node, which all their texts link, and each has the number of its own shingles; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.graph import connected_components
from quarrystone.llm.shared import discard, forget_words, id_and_text, join_counted, materialize, small_batches

BAND_ROWS = 5
MISS = 1e-6
BATCH = 24
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 1_000_000
#: Rows of a large group that all of its chunks meet first.
PIVOTS = 16
#: About so many bands a pair at the threshold shares; pairs counted by bands are taken for so many times their number.
SHARED_BANDS = 8
#: Up to so many rows of ids are broadcast, and of ids with their signatures (some 300 bytes each) to pick texts; beyond, rows are shuffled.
BROADCAST_ROWS, BROADCAST_SKETCHES = 500_000, 100_000

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z (and nothing else) in lower case: what bytes.lower and bytes.split do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; hashing a word again is faster than looking it up."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(len(w), size), np.uint64)
    for k in range(min(size, len(w))):
        h = (h ^ w[k : k + n]) * MIX_A
        h ^= h >> np.uint64(31)
    h *= MIX_B
    return np.unique(h ^ (h >> np.uint64(29)))


class MinHasher:
    """Signatures of ``bands * BAND_ROWS`` positions for a threshold, from seeded odd multipliers."""

    def __init__(self, percent: int, rows: int = BAND_ROWS, miss: float = MISS):
        self.bands = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))
        self.rows = rows
        rng = np.random.Generator(np.random.PCG64(percent))
        self.a = rng.integers(1, 1 << 63, self.bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(1, 1 << 63, self.bands * rows, dtype=np.uint64)

    def minima(self, shingles: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), block):
            x = self.a[:, None] * shingles[None, at : at + block]
            x += self.b[:, None]
            np.minimum(out, x.min(axis=1), out=out)
        return out

    def bytes_and_bands(self, minima: np.ndarray) -> tuple[bytes, np.ndarray]:
        kept = (minima * MIX_B >> np.uint64(56)).astype(np.uint8).tobytes()
        h = np.arange(1, self.bands + 1, dtype=np.uint64) * MIX_B
        for column in minima.reshape(self.bands, self.rows).T:
            h = (h ^ column) * MIX_A
            h ^= h >> np.uint64(32)
        return kept, h.view(np.int64)


def least_matches(percent: int, positions: int, miss: float = MISS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(positions seen, matches needed) after each batch.

    With a uniform prior, the similarity after m of n matches is beta(m + 1, n - m + 1), and its tail above x is
    P(Binomial(n + 1, x) <= m).  Kept bytes agree by chance with probability 1/256, which lifts the threshold.
    """
    x = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in [*range(batch, positions, batch), positions]:
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * x**m * (1 - x) ** (n + 1 - m)
        out.append((n, m))
    return out


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray, tests: list[tuple[int, int]], chunk: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that no batch prunes, and their matches."""
    kept: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(i), chunk):
        a, b = i[at : at + chunk], j[at : at + chunk]
        matches, low = np.zeros(len(a), np.int64), 0
        for high, least in tests:
            matches = matches + (sig[a, low:high] == sig[b, low:high]).sum(axis=1)
            ok = matches >= least
            a, b, matches, low = a[ok], b[ok], matches[ok], high
            if not len(a):
                break
        kept.append((a, b, matches))
    if not kept:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def pairs_in(left: int, right: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs in pieces: all i < j of ``left`` rows if ``right`` is 0, else those across to the ``right`` rows behind them."""
    step = max(1, 50_000 // max(1, right or left))
    for at in range(0, left, step):
        rows = np.arange(at, min(at + step, left))
        if right:
            yield np.repeat(rows, right), np.tile(np.arange(left, left + right), len(rows))
        else:
            i, j = np.nonzero(rows[:, None] < np.arange(left)[None, :])
            yield rows[i], j


class Forest:
    """Which rows of one group are joined so far, as a label a row; rows with equal codes are from the start."""

    def __init__(self, n: int, codes: np.ndarray | None = None):
        self.label = np.arange(n)
        if codes is not None:
            _, first, place = np.unique(codes, return_index=True, return_inverse=True)
            self.label = first[place]

    def open_pairs(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that no links join yet."""
        apart = self.label[i] != self.label[j]
        return i[apart], j[apart]

    def apart(self, a: int, b: int) -> bool:
        return self.label[a] != self.label[b]

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.label[a], self.label[b]))
        self.label[self.label == b] = a


def runs(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows with equal leading keys, of partitions sorted by them: tables of about ``rows`` rows, and where each
    run begins and the table ends.  Only a longer run is held longer."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, rows

    def cut(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(k).to_numpy() for k in range(n_keys)], axis=1)
        return np.concatenate(([0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, [table.num_rows]))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= enough:
            table = pa.Table.from_batches(held)
            starts = cut(table)
            last = int(starts[-2])
            if last:
                yield table.slice(0, last), starts[:-1]
                table = table.slice(last)
            held = table.combine_chunks().to_batches()
            size = table.num_rows
            enough = max(rows, 2 * size)
    if size:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def pairs_of_runs(starts: np.ndarray, side: np.ndarray, within: bool, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of each run, in pieces: all pairs of a run of side 0 only; else those across to side 1, which lies behind, and
    with ``within`` also those of side 0."""
    at, sizes = starts[:-1], np.diff(starts)
    lefts = np.add.reduceat(side == 0, at)
    whole = lefts == sizes
    for n in np.unique(sizes[whole & (sizes > 1) & (sizes <= small)]).tolist():
        i, j = np.triu_indices(n, 1)
        begins = at[whole & (sizes == n)]
        step = max(1, 50_000 // len(i))
        for k in range(0, len(begins), step):
            some = begins[k : k + step, None]
            yield (some + i).ravel(), (some + j).ravel()
    for k in np.nonzero(~whole | (sizes > small))[0].tolist():
        for right in {0} if whole[k] else {0, int(sizes[k] - lefts[k])} if within else {int(sizes[k] - lefts[k])}:
            for i, j in pairs_in(int(lefts[k]), right):
                yield i + at[k], j + at[k]


LINKS = "grp bigint, row bigint, a bigint, b bigint"
LINK = pa.schema([(name, pa.int64()) for name in ("grp", "row", "a", "b")])


def link_batches(links: Iterator[list[tuple]], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    for some in links:
        found += some
        if len(found) >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=LINK)
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=LINK)


def sketches(docs: DataFrame, size: int, hasher: MinHasher) -> DataFrame:
    """(doc_id, key, n_shingles, sig, bands); a text without words has no key."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch in batches:
            keys, counts, sigs, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                shingles = shingle_set(words, size)
                counts.append(len(shingles))
                if not words:
                    keys.append(None), sigs.append(None), bands.append(None)
                    continue
                kept, band = hasher.bytes_and_bands(hasher.minima(shingles))
                keys.append(blake2b(b" ".join(words), digest_size=16).digest()), sigs.append(kept), bands.append(band)
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_shingles", "sig", "bands"])

    return id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(sketch, "doc_id bigint, key binary, n_shingles bigint, sig binary, bands array<bigint>")


def compared(rows: DataFrame, tests: list[tuple[int, int]], percent: int, size: int, pivots: bool = False) -> DataFrame:
    """Links of rows (grp, part, chunk, side, row, doc_id, key, sig, text), found where a (grp, part, chunk) meets; sorted for
    streaming.  Rows with a text are checked exactly on its shingles, if it is the one of their key.

    Links have no grp.  With ``pivots``, side 0, every row of side 1 is told too, as b with the first pivot that joins it, or null.  Rows that have
    the same ``label``, if there is one, are joined already.
    """
    exact, known = "text" in rows.columns, "label" in rows.columns
    lead = ["grp", "part", "chunk", "side", "row"]
    rows = rows.select(*lead, "doc_id", "key", "sig", *(["label"] if known else []), *(["text"] if exact else []))
    rows = rows.repartition("grp", "part", "chunk").sortWithinPartitions(*lead)

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingle sets instead of texts; rows with another text of the same doc_id, and repeated ones, drop out."""
        forget_words()
        last = None
        for batch in batches:
            keep, sets = [], []
            place = list(zip(*(batch.column(c).to_pylist() for c in (*lead, "key")), strict=True))
            for here, text in zip(place, batch.column("text").to_pylist(), strict=True):
                ok = here != last
                words = words_of(text) if ok else []
                ok = ok and blake2b(b" ".join(words), digest_size=16).digest() == here[-1]
                keep.append(ok)
                if ok:
                    last = here
                    sets.append(shingle_set(words, size).tobytes())
            left = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*left.columns[:-1], pa.array(sets, pa.binary())], names=[*left.schema.names[:-1], "set"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[list[tuple]]:
            for table, starts in runs(with_sets(batches) if exact else batches, 3, 256 if exact else 4096):
                ids, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
                sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
                sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()] if exact else None
                forest = Forest(len(ids), table.column("label").combine_chunks().dictionary_encode().indices.to_numpy() if known else None)
                found: list[tuple] = []
                for i, j in pairs_of_runs(starts, side, pivots):
                    i, j, matches = surviving(sig, *forest.open_pairs(i, j), tests)
                    if exact:
                        order = np.argsort(-matches, kind="stable")
                        i, j = i[order], j[order]
                    for a, b in zip(i.tolist(), j.tolist(), strict=True):
                        if forest.apart(a, b) and (sets is None or linked(sets[a], sets[b], percent)):
                            forest.join(a, b)
                            found.append((None, None, int(ids[a]), int(ids[b])))
                if pivots:
                    grp, row = table.column("grp").to_numpy(), table.column("row").to_numpy()
                    for k in np.nonzero(side == 1)[0].tolist():
                        first = int(forest.label[k])  # the first of its rows, and side 0 comes first
                        found.append((int(grp[k]), int(row[k]), int(ids[k]), int(ids[first]) if side[first] == 0 else None))
                yield found

        yield from link_batches(links())

    return rows.mapInArrow(compare, LINKS)


def group_links(rows: DataFrame, n_large: int, tests: list[tuple[int, int]], percent: int, size: int = 0, bands: DataFrame | None = None) -> DataFrame:
    """(a, b): links that join, in each group, all that its pairs link.

    ``rows`` (grp, chunks, row, doc_id, key, sig and, for an exact check, text); ``n_large`` groups have more than one chunk.  What pivots leave apart
    in a large group meets all of its chunks or, with ``bands`` (row, bands) and where that moves fewer rows, by the bands that it shares.
    """
    zero = F.lit(0)
    small = compared(rows.filter("chunks = 1").withColumns({"part": zero, "chunk": zero, "side": zero}), tests, percent, size).select("a", "b")
    if not n_large:
        return small
    large = materialize(rows.filter("chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")), "large-groups")
    # The same few pivots for every chunk of a group: the least rows of so many hash classes.
    least = large.groupBy("grp", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(PIVOTS)).alias("class")).agg(F.min("row").alias("row")).select("grp", "row")
    every_chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pivots = large.join(F.broadcast(least) if n_large * PIVOTS <= BROADCAST_ROWS else least, ["grp", "row"], "left_semi").withColumn("chunk", every_chunk)
    met = pivots.withColumn("side", zero).unionByName(large.withColumn("side", F.lit(1))).withColumn("part", zero)
    told = materialize(compared(met, tests, percent, size, pivots=True), "pivot-links")
    joined = small.unionByName(told.filter("grp IS NULL").select("a", "b"))
    labels = told.filter("grp IS NOT NULL").groupBy("grp", "row").agg(F.min("b").alias("label"))
    name = F.coalesce(F.col("label").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    own = materialize(labels.select("grp", "row", "label", name.alias("name")), "labels")
    hint = F.broadcast if n_large <= BROADCAST_ROWS else lambda table: table

    # What is not joined with the group's largest part meets all of its chunks.
    parts = own.filter("label IS NOT NULL").groupBy("grp", "label").agg(F.count("*").alias("n"))
    largest = parts.groupBy("grp").agg(F.max_by("label", "n").alias("largest"))
    rest = own.join(hint(largest), "grp", "left").filter("label IS NULL OR label != largest").select("grp", "row")
    rest = materialize(rest, "pivot-rest")
    n_rest = rest.groupBy("grp").agg(F.count("*").alias("n_rest")).withColumn("ways", F.ceil(F.col("n_rest") / (BLOCK_DOCS // 2)).cast("int"))
    if bands is not None:
        members = own.select(F.col("grp").alias("cluster"), "row", F.col("name").alias("label")).join(bands, "row")
        mixed = materialize(mixed_bands(members), "mixed-bands")
        by_bands = mixed.groupBy(F.col("cluster").alias("grp")).agg(F.sum(F.col("n") * (F.col("n") - F.col("most"))).alias("pairs"))
        sizes = large.groupBy("grp").agg(F.count_distinct("row").alias("n"), F.max("chunks").alias("chunks"))
        moved = F.col("n") * F.col("ways") + F.col("n_rest") * F.col("chunks")
        n_rest = materialize(n_rest.join(sizes, "grp").join(by_bands, "grp").filter(F.col("pairs") > SHARED_BANDS * moved).select("grp", "n_rest", "ways"), "groups-in-blocks")
        gone = hint(n_rest.select(F.col("grp").alias("cluster")))
        members = members.join(gone, "cluster", "left_anti").join(large.select("row", "sig").dropDuplicates(["row"]), "row")
        pairs = pairs_apart(members, mixed.join(gone, "cluster", "left_anti"), tests)
        joined = joined.unionByName(star_links(large, materialize(pairs.distinct(), "open-pairs"), tests, percent, size))
        if n_rest.isEmpty():
            return joined
    open_ = large.join(hint(n_rest), "grp").join(own.select("grp", "row", F.col("name").alias("label")), ["grp", "row"])
    left = open_.join(rest, ["grp", "row"], "left_semi").withColumn("part", F.pmod(F.xxhash64("row", F.lit(2)), F.col("ways")).cast("int")).withColumn("chunk", every_chunk)
    right = open_.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    met = left.withColumn("side", zero).unionByName(right.withColumn("side", F.lit(1)))
    return joined.unionByName(compared(met, tests, percent, size).select("a", "b"))


def mixed_bands(members: DataFrame) -> DataFrame:
    """(cluster, grp, n, most, commonest): the bands, as grp, that rows of several labels share, of members (cluster, row, label, bands); how many rows each
    has, and how many of its commonest label."""
    held = members.select("cluster", F.explode("bands").alias("band"), "label").withColumn("grp", F.xxhash64("cluster", "band"))
    by_label = held.groupBy("cluster", "grp", "label").agg(F.count("*").alias("n"))
    bands = by_label.groupBy("cluster", "grp").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", "n").alias("commonest"), F.count("*").alias("labels"))
    return bands.filter("labels > 1").drop("labels")

def pairs_apart(members: DataFrame, mixed: DataFrame, tests: list[tuple[int, int]]) -> DataFrame:
    """(a, b): rows of a cluster that share a band, bear different labels and pass the Bayesian test, of members (cluster, row, label, bands, sig) and
    their ``mixed_bands``.

    Only signatures are moved: once for each band that holds several labels.  In a band of more rows than a task compares, those outside its
    commonest label meet all of it in blocks.
    """
    held = members.select("cluster", F.explode("bands").alias("band"), "row", "label", "sig").withColumn("grp", F.xxhash64("cluster", "band")).drop("cluster", "band")
    ways, chunks = F.ceil((F.col("n") - F.col("most")) / (BLOCK_DOCS // 2)).cast("int"), F.ceil(F.col("n") / BLOCK_DOCS).cast("int")
    bands = materialize(mixed.select("grp", "n", "commonest", ways.alias("ways"), chunks.alias("chunks")), "bands-apart")
    rows = join_counted(held, bands, ["grp"], "n")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.filter("label != commonest").withColumn("part", F.pmod(F.xxhash64("row", F.lit(2)), F.col("ways")).cast("int")).withColumn("chunk", every("chunks")).withColumn("side", F.lit(0))
    right = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int")).withColumn("part", every("ways")).withColumn("side", F.lit(1))
    names = ["grp", "part", "chunk", "side", "row", "label", "sig"]
    met = left.select(*names).unionByName(right.select(*names)).repartition("grp", "part", "chunk").sortWithinPartitions(*names[:5])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in runs(batches, 3, 4096):
            row, side = table.column("row").to_numpy(), table.column("side").to_numpy()
            label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(row), -1)
            for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                n = int((side[at:end] == 0).sum())
                for i, j in pairs_in(n, end - at - n) if 0 < n < end - at else ():
                    i, j = i + at, j + at
                    apart = label[i] != label[j]
                    i, j, _ = surviving(sig, i[apart], j[apart], tests)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(row[i], row[j])), pa.array(np.maximum(row[i], row[j]))], names=["a", "b"])

    return met.mapInArrow(compare, "a bigint, b bigint")


def star_links(rows: DataFrame, pairs: DataFrame, tests: list[tuple[int, int]], percent: int, size: int) -> DataFrame:
    """(a, b): the links among pairs (a, b: rows), checked on the texts of ``rows`` (row, doc_id, key, sig, text): a row meets its partners, and a text is
    moved once for each row that it is a partner of."""
    partners = pairs.withColumn("chunk", F.lit(0)) if pairs.isEmpty() else pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("chunks")), "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int")).drop("chunks")
    centers = partners.select(F.col("a").alias("grp"), "chunk", F.col("a").alias("row")).distinct().withColumn("side", F.lit(0))
    met = centers.unionByName(partners.select(F.col("a").alias("grp"), "chunk", F.col("b").alias("row")).withColumn("side", F.lit(1))).withColumn("part", F.lit(0))
    texts = rows.select("row", "doc_id", "key", "sig", "text")
    return compared(met.join(texts, "row"), tests, percent, size).select("a", "b")


def candidate_links(reps: DataFrame, tests: list[tuple[int, int]]) -> DataFrame:
    """Spanning forests of what survives the Bayesian test in each shared band."""
    members = reps.select(F.explode("bands").alias("grp"), "row")
    chunks = F.ceil(F.col("n") / BLOCK_DOCS).cast("int")
    shared = materialize(members.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1").select("grp", "n", chunks.alias("chunks")), "bands")
    rows = join_counted(members, shared, ["grp"], "n").drop("n").join(reps.select("row", "doc_id", "key", "sig"), "row")
    return group_links(rows, shared.filter("chunks > 1").count(), tests, 0)


def verified_links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, size: int, percent: int, tests: list[tuple[int, int]]) -> DataFrame:
    """Spanning forests of the exact links inside each candidate cluster."""
    nodes = clusters.join(reps.select(F.col("doc_id").alias("node"), "row", "key", "n_shingles", "sig"), "node")
    weight = nodes.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("chunks"))
    weight = materialize(weight, "cluster-sizes")
    nodes = materialize(nodes.join(weight, "component").select(F.col("component").alias("grp"), F.col("node").alias("doc_id"), "chunks", "row", "key", "sig"), "cluster-nodes")
    picked = F.broadcast(nodes) if nodes.count() <= BROADCAST_SKETCHES else nodes
    return group_links(id_and_text(docs).join(picked, "doc_id"), weight.filter("chunks > 1").count(), tests, percent, size, reps.select("row", "bands"))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the exact Jaccard similarity reaches the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document; the class is named by its smallest doc_id."""
    spark = docs.sparkSession
    hasher = MinHasher(percent)
    tests = least_matches(percent, hasher.bands * hasher.rows)
    sketch = materialize(sketches(docs, size, hasher), "sketches")
    keyed = sketch.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    firsts = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "first-copies")
    # One row a text, told by a hash of its key; its node is the smallest doc_id that has it.
    reps = keyed.join(firsts.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["key"])
    reps = materialize(reps.withColumn("row", F.xxhash64("key")), "representatives")
    # Documents with several texts join the nodes of all of them.
    told = sketch.filter("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("key"))
    several = told.groupBy("doc_id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).filter("least < most").select("doc_id")
    own = keyed.join(several, "doc_id", "left_semi").join(firsts.drop("n"), "key").filter("rep != doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    own = materialize(own.distinct(), "shared-ids")
    small_batches(spark, 4096)
    clusters = materialize(connected_components(candidate_links(reps, tests)), "clusters")
    small_batches(spark)
    links = materialize(connected_components(verified_links(docs, reps, clusters, size, percent, tests).unionByName(own)), "links")
    discard(reps)
    # Texts that one document has alone, linked with nothing, need no row.
    classes = firsts.join(links, firsts["rep"] == links["node"], "left").filter("n > 1 OR node IS NOT NULL").select("key", "n", F.coalesce("component", "rep").alias("class"))
    out = join_counted(sketch.filter("key IS NOT NULL").select("doc_id", "key", "n_shingles"), materialize(classes, "classes"), ["key"], "n", "left").drop("key", "n")
    bare = sketch.filter("key IS NULL").join(links, F.col("doc_id") == links["node"], "left")  # another text of its doc_id can be linked
    out = out.unionByName(bare.select("doc_id", "n_shingles", F.col("component").alias("class")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents of each class that bear its smallest id; columns as they came."""
    gone = materialize(near_duplicates(docs, size, percent).filter("NOT kept").select("doc_id"), "later-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
