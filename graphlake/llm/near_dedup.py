"""Near-duplicate detection with DartMinHash signatures.

A text is the weighted set of its five-word shingles, each weighing as often as it occurs. Darts are thrown by hash
into the (weight x rank) regions of its shingles; the earliest dart of each coordinate is kept, so two texts agree on
a coordinate with the probability of their weighted Jaccard similarity. Bands of coordinates are joined; candidates
are verified on the full texts, and verified links are closed into classes.

Texts with the same words become one representative before anything else, and the members of a bucket are first compared
with one of them, which is linear. Of buckets that then still hold several classes most members can be similar to none
of another class: two similar sets share one of the rarest 20 % of the elements of either, so whoever shares no such
element, as texts do that have but a passage in common, is done. The others are compared within their buckets, in blocks
dealt over tasks, which emit no more links than join their classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, clean_texts, text_blocks
from .words import SEED, mix, occurrences, shingles, word_hashes

WIDTH, SIMILARITY = 5, 0.8
#: A pair at similarity 0.8 shares none of the bands with a probability of (1 - 0.8**5)**32, or 3 in a million.
ROWS, BANDS = 5, 32
COORDINATES = ROWS * BANDS
#: Candidates whose sketches agree on less than this share of coordinates are dropped: 4.5 standard deviations below 0.8.
PLAUSIBLE = SIMILARITY - 4.5 * (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5
#: A list of up to so many ids (8 bytes each) is sent to all executors.
BROADCAST_IDS = 1_000_000
#: A text takes as much room as so many characters, whatever its length.
PER_TEXT = 2048
#: Members of one bucket that are compared with each other in one task.
BLOCK = 512
#: Chances of 0, 1, 2 ... darts in a region where one is expected.
_POISSON = np.cumsum([float(np.exp(-1.0)) / float(np.prod(range(1, n + 1))) for n in range(12)])


def _darts(element: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts in one rank cell of each element: indexes of the elements, regions within the cell, and dart hashes."""
    regions = 1 << max(0, cell - 1)
    region = np.tile(np.arange(regions, dtype=np.uint64), len(element))
    h = mix(np.repeat(element, regions) ^ mix((region + np.uint64(cell * 0x10001)) * SEED))
    number = np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")
    at = np.repeat(np.arange(len(h)), number)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(number) - number, number)
    return at // regions, region[at], mix(h[at] + (nth.astype(np.uint64) + np.uint64(1)) * SEED)


def signatures(gram: np.ndarray, owner: np.ndarray, texts: int, coordinates: int = COORDINATES) -> np.ndarray:
    """texts x coordinates: the hash of the earliest dart. gram, owner: all shingles with their texts, in order of texts.

    A text without shingles has a row of zeros.
    """
    element, owner = occurrences(gram, owner)  # the n-th occurrence is the n-th unit of weight
    weight = np.bincount(owner, minlength=texts)
    need = coordinates * np.log(coordinates) + 2 * coordinates
    # cells of the rank axis: [0, 1), [1, 2), [2, 4), [4, 8) ...; a text needs those up to its own number
    cells = np.where(weight > 0, np.ceil(np.log2(np.maximum(1, need / np.maximum(1, weight)))).astype(np.int64) + 1, 0)
    out, done = np.zeros((texts, coordinates), np.uint64), weight == 0
    best = np.full(texts * coordinates, np.iinfo(np.uint64).max, np.uint64)
    cell = 0
    while not done.all():
        mine = np.flatnonzero(~done[owner])
        at, region, dart = _darts(element[mine], cell)
        # earlier cells come first, then earlier regions in the cell, then the dart's own place
        rank = np.uint64(cell) << np.uint64(58) | region << np.uint64(40) | dart >> np.uint64(24)
        slot = owner[mine[at]] * coordinates + ((dart & np.uint64(0xFFFFFF)) % np.uint64(coordinates)).astype(np.int64)
        first = np.lexsort((rank, slot))
        slot, rank = slot[first], rank[first]
        head = np.ones(len(slot), bool)
        head[1:] = slot[1:] != slot[:-1]
        best[slot[head]] = np.minimum(best[slot[head]], rank[head])
        cell += 1
        full = (best.reshape(texts, coordinates) != np.iinfo(np.uint64).max).all(axis=1)
        done |= full & (cells <= cell)
    out[:] = mix(best.reshape(texts, coordinates))
    out[weight == 0] = 0
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """texts x BANDS: one hash for the rows of each band."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix(out + signature[:, r::ROWS] + SEED)
    return mix(out ^ np.arange(1, BANDS + 1, dtype=np.uint64) * SEED)


def _profile(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """All shingles, their texts, and a 16-byte name of each text's words; a text without words has an empty name."""
    words, first = word_hashes(texts)
    gram, owner = shingles(words, first, WIDTH)
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    halves = []
    for salt in (1, 2):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(words + mix((place.astype(np.uint64) + np.uint64(1)) * SEED + np.uint64(salt))))))
        halves.append(mix(sums[first[1:]] - sums[first[:-1]]))
    names = np.stack(halves, axis=1).astype("<u8")
    return gram, owner, [n.tobytes() if b > a else b"" for n, a, b in zip(names, first[:-1], first[1:])]


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, name, sketch (a byte per coordinate), bands."""

    def run(batches):
        for batch, texts in text_blocks(batches, 1 << 18, PER_TEXT):
            gram, owner, names = _profile(texts)
            signature = signatures(gram, owner, len(texts))
            sketch = signature.astype(np.uint8)
            keys = bands(signature).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(names, pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary()), lists], ["doc_id", "name", "sketch", "bands"]
            )

    return clean_texts(docs).mapInArrow(run, "doc_id bigint, name binary, sketch binary, bands array<bigint>")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of coordinates that sketches agree on, without what bytes agree on by chance."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches (rep, sketch) agree on enough coordinates; repeated pairs stay repeated, none give none."""
    both = pairs.join(sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b")), "b")

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 3))
            keep = pa.array(np.flatnonzero(_agreement(a, b) >= PLAUSIBLE))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint")


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle lists with repeats."""
    both = np.concatenate((left, right))
    if not len(both):
        return 0.0
    values, number = np.unique(both, return_inverse=True)
    a, b = np.bincount(number[: len(left)], minlength=len(values)), np.bincount(number[len(left) :], minlength=len(values))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the given ids, one row each: of texts with the same doc_id the smallest. Null ids are none.

    A list of ids of proven size goes to the executors, a longer one is joined.
    """
    small = ids.count() <= BROADCAST_IDS
    return clean_texts(docs).join(F.broadcast(ids) if small else ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def verify(pairs: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full texts are similar, with their similarity.

    Texts of any length are compared whole; null and empty ones are similar to none; pairs of ids that docs does not have
    are dropped, and of texts with the same doc_id the smallest counts. No pairs give no rows.
    """
    # written, so that a hub's many pairs can be split over tasks, each with its one text
    texts = scratch.keep(texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                gram, owner, _ = _profile([t or "" for i in (2, 3) for t in part.column(i).to_pylist()])
                ends = np.searchsorted(owner, np.arange(2 * part.num_rows + 1))
                lists = [np.sort(gram[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                score = np.array([similarity(lists[i], lists[i + part.num_rows]) for i in range(part.num_rows)])
                keep = pa.array(np.flatnonzero(score >= SIMILARITY))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(score).take(keep)], ["a", "b", "similarity"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def components(spark: SparkSession, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, class: the smallest node of each connected component of the links (a, b); alternating stars, until nothing changes."""
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    state = None
    for step in count(1):
        # large star: every larger neighbour points at the smallest neighbour
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node's smaller neighbours and itself point at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = scratch.keep(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))


def elements(docs: DataFrame) -> DataFrame:
    """rep, grams: each text's weighted shingles as a sorted set, in which the n-th occurrence is an element of its own.

    Reads doc_id and text, a row for each row. Null texts and texts without words have an empty set.
    """

    def run(batches):
        for batch, texts in text_blocks(batches, 1 << 18, PER_TEXT):
            gram, owner, _ = _profile(texts)
            element, owner = occurrences(gram, owner)
            element = element.astype(np.int64)
            element = element[np.lexsort((element, owner))]
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(element))], ["rep", "grams"])

    return clean_texts(docs).mapInArrow(run, "rep bigint, grams array<bigint>")


def rare(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """key, rep, class: the elements of each set (rep, class, grams) that any similar set must share one of.

    Two sets of similarity 0.8 share 80 % of the elements of either. So they share one of the rarest 20 % and one more
    of each, in any order that is the same for all: here by the number of sets that have the element. What only one set
    has is shared with none and is left out.
    """
    every = grams.select("rep", "class", F.size("grams").alias("n"), F.explode("grams").alias("key"))
    often = scratch.keep(every.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    shared = every.join(often, "key")
    own = Window.partitionBy("rep")
    place = F.row_number().over(own.orderBy("often", "key"))
    alone = F.col("n") - F.count("*").over(own)
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1
    return shared.withColumn("place", place).withColumn("alone", alone).filter(F.col("place") <= prefix - F.col("alone")).select("key", "rep", "class")


def _blocked(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs of blocks of each key: members are dealt into blocks, and each pair of blocks is a group of its own."""
    number = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.join(sizes, "key").withColumn("blocks", number).withColumn("mine", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return dealt.select("key", "rep", "class", "mine", other).select("key", "rep", "class", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def _links_within(group: pa.Table) -> list[tuple[int, int]]:
    """Links that join the classes of a group (one pair of blocks of one bucket), each pair in its first common band only."""
    rep, cls, mine = (group.column(c).to_numpy() for c in ("rep", "class", "mine"))
    key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
    keys = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    lists = group.column("grams").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    grams = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    names, number = np.unique(cls, return_inverse=True)
    top = list(range(len(names)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    right = np.flatnonzero(mine == j)
    for x in np.flatnonzero(mine == i):
        own = find(number[x])
        y = right[number[right] != number[x]] if i != j else right[(number[right] != number[x]) & (rep[right] > rep[x])]
        y = y[_agreement(sketch[x], sketch[y]) >= PLAUSIBLE] if len(y) else y
        y = y[[find(c) != own for c in number[y].tolist()]] if len(y) else y
        y = y[keys[x][(keys[x] == keys[y]).argmax(axis=1)] == key] if len(y) else y
        if not len(y):
            continue
        sizes = np.array([len(grams[k]) for k in y])
        every = np.concatenate([grams[k] for k in y])
        at = np.minimum(np.searchsorted(grams[x], every), len(grams[x]) - 1)
        both = np.add.reduceat((grams[x][at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
        for k in y[both >= SIMILARITY * (len(grams[x]) + sizes - both)].tolist():
            a, b = find(number[x]), find(number[k])
            if a != b:
                top[a] = b
                out.append((max(int(rep[x]), int(rep[k])), min(int(rep[x]), int(rep[k]))))
    return out


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between classes within each group (key, i, j); the rows come sorted by group."""
    rest: pa.Table | None = None

    def links(group: pa.Table) -> pa.RecordBatch:
        found = _links_within(group)
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None and rest.num_rows else now
        if not now.num_rows:
            continue
        keys = [now.column(c).to_numpy() for c in ("key", "i", "j")]
        at = 0
        for c in (np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist():
            yield links(now.slice(at, c - at))
            at = c
        rest = now.slice(at)
    if rest is not None and rest.num_rows:
        yield links(rest)


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size, is_first for each row.

    Reads doc_id and text, whatever other columns there are; doc_id is taken to name a text. Texts without words (null,
    empty, punctuation) are classes of their own; a text of fewer than five words has one shingle of them all; texts of any
    length are compared whole. Equal words are similar whatever their case and punctuation. Rows repeated with a doc_id
    share its class; a null doc_id is a class of its own. An empty table gives no rows.
    """
    scratch = Scratch(spark, "near")
    signed = scratch.keep(sign(docs.filter("doc_id is not null")), "signed")
    named = signed.select("doc_id", "name").filter("name <> x''")
    same = scratch.keep(named.groupBy("name").agg(F.min("doc_id").alias("rep")), "same")
    reps = signed.filter("name <> x''").join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    reps = scratch.keep(reps.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "sketch", "bands"), "reps")
    bucket = reps.select("rep", F.explode("bands").alias("key"))
    hubs = bucket.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = scratch.keep(bucket.join(hubs, "key"), "members")
    stars = members.filter("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    sketches = reps.select("rep", "sketch")
    likely = scratch.keep(plausible(stars, sketches), "likely")
    links = scratch.keep(verify(likely, docs, scratch).select("a", "b"), "links")
    scratch.drop("texts", "likely")
    first = components(spark, links, scratch, "first")
    # Buckets that still hold several classes: whoever is no hub may yet be linked with another class there.
    held = members.filter("n > 2 and rep <> hub").select("key", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    held = scratch.keep(held, "held")
    mixed = held.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter("least <> most").select("key")
    held = scratch.keep(held.join(mixed, "key", "left_semi"), "rest")
    scratch.drop("members", "held")
    # Of those, whoever shares no rare element with a member of another class is similar to none.
    rest = scratch.keep(held.select("rep", "class").distinct(), "some")
    grams = scratch.keep(elements(texts_of(docs, rest.select(F.col("rep").alias("doc_id")))).join(rest, "rep"), "grams")
    keys = scratch.keep(rare(grams, scratch), "rare")
    shared = keys.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).filter("least <> most").select("key")
    near = scratch.keep(keys.join(scratch.keep(shared, "shared"), "key", "left_semi").select("rep").distinct(), "near")
    held = held.join(near, "rep", "left_semi")
    mixed = held.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n")).filter("least <> most").select("key", "n")
    groups = _blocked(held, scratch.keep(mixed, "mixed")).join(reps, "rep").join(grams.select("rep", "grams"), "rep")
    across = groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(_across, "a bigint, b bigint")
    links = links.unionByName(scratch.keep(across, "across"))
    joined = components(spark, links, scratch, "all")
    scratch.drop("reps", "links", "rest", "some", "grams", "often", "rare", "shared", "near", "mixed", "across")
    of_rep = same.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("name", F.coalesce("class", "rep").alias("class_id"))
    # a hot name is one row of of_rep: Spark splits its side of the join
    found = signed.select("doc_id", "name").join(of_rep, "name", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    found = found.unionByName(docs.filter("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("class_id")))
    sizes = found.groupBy("class_id").agg(F.count("*").alias("class_size"))
    out = found.join(sizes.filter("class_id is not null"), "class_id", "left")
    return out.select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("is_first"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the first of its class, with all their columns as they are, however named.

    Null doc_ids stay, and so do all rows repeated with a doc_id that stays; texts of any length are compared whole.
    """
    dropped = Scratch(spark, "near").keep(classes(spark, docs).filter("not is_first").select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti")

