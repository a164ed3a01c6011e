"""MinHash, banding, vectors and combined similarity of nodes and documents."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .lineage import cut

#: A prime; permutation k of a hash h below 2**28 is (a_k h + b_k) mod PRIME, exact in 64-bit integers.
PRIME = 2147483647
SIZE, BANDS = 64, 32


def coefficients(size: int = SIZE) -> list[tuple[int, int]]:
    """Fixed multipliers and offsets, from a linear congruential rule."""
    out, x = [], 42
    for _ in range(size):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            pair.append((x >> 33) % (PRIME - 1) + 1)
        out.append((pair[0], pair[1]))
    return out


def word_shingles(text: Column, width: int = 3) -> Column:
    """Distinct shingles of whole words; a text of fewer words has one shingle of them all."""
    def windows(words: Column) -> Column:
        every = F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " ")))
        return every.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(scalar.let(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), windows))


def minhash(docs: DataFrame, key: str, text: str, size: int = SIZE, width: int = 3, least: int = 0) -> DataFrame:
    """key, signature (array of `size` numbers); documents of fewer than `least` shingles have none. key names a document.

    Each shingle is hashed once and the smallest value of each permutation kept as rows pass by, so what is shuffled is
    one row for each document.
    """
    hashes = F.transform(word_shingles(F.col(text), width), lambda s: F.conv(F.substr(F.md5(s.cast("binary")), F.lit(1), F.lit(7)), 16, 10).cast("bigint"))
    every = docs.select(key, hashes.alias("_h")).filter(F.size("_h") >= max(least, 1)).select(key, F.explode("_h").alias("_h"))
    least_of = [F.min((F.col("_h") * F.lit(a) + F.lit(b)) % F.lit(PRIME)).alias(f"_{i}") for i, (a, b) in enumerate(coefficients(size))]
    return every.groupBy(key).agg(*least_of).select(key, F.array(*(F.col(f"_{i}") for i in range(size))).alias("signature"))


def bands(signatures: DataFrame, key: str, bands: int = BANDS, size: int = SIZE) -> DataFrame:
    """key, band, bucket: one row for each band of each signature."""
    rows = size // bands
    parts = F.array(*(F.struct(F.lit(b).alias("band"), F.slice("signature", b * rows + 1, rows).alias("bucket")) for b in range(bands)))
    return signatures.select(key, F.explode(parts).alias("p")).select(key, "p.band", "p.bucket")


#: Members of a bucket that are compared with each other in one task.
MEMBERS = 512


def representatives(signatures: DataFrame, key: str) -> DataFrame:
    """rep, key: of documents with the same signature the smallest key stands for all."""
    first = signatures.groupBy("signature").agg(F.min(key).alias("rep"))
    return signatures.join(first, "signature").select("rep", key)


def similar_pairs(signatures: DataFrame, key: str, least: float, size: int = SIZE, n_bands: int = BANDS, most: int | None = None) -> DataFrame:
    """a, b, jaccard: pairs a < b of different signatures that share a bucket and agree on a share of `least` of their places.

    One document stands for all of the same signature. Buckets are dealt into blocks, and two blocks of a bucket meet in
    one task, which gives only the pairs that are similar enough, each in the first band that it shares. most: buckets
    of more members are passed over.
    """
    own = cut(signatures.groupBy("signature").agg(F.min(key).alias("rep")))
    banded = bands(own, "rep", n_bands, size).select("rep", F.xxhash64("band", "bucket").alias("bucket"), "band")
    groups = banded.groupBy("bucket", "band").agg(F.count("*").alias("n")).filter("n > 1")
    groups = groups if most is None else groups.filter(F.col("n") <= most)
    number = F.ceil(F.col("n") / MEMBERS).cast("int")
    dealt = banded.join(groups, ["bucket", "band"]).withColumn("blocks", number).withColumn("mine", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep").join(own, "rep")
    dealt = dealt.select("band", "bucket", "i", "j", "mine", "rep", "signature").repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j", "rep")
    rows = size // n_bands

    def pairs(group: pa.Table) -> pa.RecordBatch:
        band, i, j = (group.column(c)[0].as_py() for c in ("band", "i", "j"))
        mine, rep = group.column("mine").to_numpy(), group.column("rep").to_numpy()
        places = group.column("signature").combine_chunks().flatten().to_numpy().reshape(len(rep), size)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for x in left:
            y = right[rep[right] > rep[x]] if i == j else right
            same = places[x] == places[y]
            share = same.sum(axis=1) / size
            bands_shared = same.reshape(len(y), n_bands, rows).all(axis=2)
            keep = (share >= least) & bands_shared[:, band]
            if most is None:
                keep &= bands_shared.argmax(axis=1) == band
            found.append((np.minimum(rep[x], rep[y[keep]]), np.maximum(rep[x], rep[y[keep]]), share[keep]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b", "jaccard"])

    def run(batches):
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            keys = [now.column(c).to_numpy() for c in ("band", "bucket", "i", "j")]
            at = 0
            for c in (np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist():
                yield pairs(now.slice(at, c - at))
                at = c
            rest = now.slice(at)
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    found = dealt.mapInArrow(run, "a bigint, b bigint, jaccard double")
    return found if most is None else found.distinct()  # the first band may be one that is passed over


def candidates(signatures: DataFrame, key: str, most: int | None = None, size: int = SIZE, n_bands: int = BANDS) -> DataFrame:
    """Pairs (a, b), a < b, of one document for each signature that share a bucket. most: buckets of more members are passed over."""
    return similar_pairs(signatures, key, 0.0, size, n_bands, most).select("a", "b")


def scored(pairs: DataFrame, signatures: DataFrame, key: str) -> DataFrame:
    """The pairs with jaccard, the share of equal places of their signatures."""
    a = signatures.select(F.col(key).alias("a"), F.col("signature").alias("_a"))
    b = signatures.select(F.col(key).alias("b"), F.col("signature").alias("_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", scalar.signature_jaccard(F.col("_a"), F.col("_b")).alias("jaccard"))


def top_edges(edges: DataFrame, owner: str, order: list[Column], most: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return edges.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def similar_edges(nodes: DataFrame, signatures: DataFrame, threshold: float = 0.95, most: int = 10) -> DataFrame:
    """SIMILAR_TO edges between nodes whose files have the same extension: source_id, target_id, jaccard, same_file.

    nodes: id, qualified_name, file_path; signatures: id, signature. A pair belongs to the lesser qualified name. Nodes of
    the same signature are linked with the smallest id among them, which stands for all towards the others.
    """
    names = nodes.select("id", "qualified_name", "file_path", F.regexp_extract("file_path", r"\.([^./]*)$", 1).alias("ext"))
    pairs = similar_pairs(signatures, "id", threshold)
    pairs = pairs.unionByName(representatives(signatures, "id").filter("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard")))
    for side in ("a", "b"):
        pairs = pairs.join(names.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("qualified_name", "file_path", "ext"))), side)
    pairs = pairs.filter("ext_a = ext_b")
    first = F.struct("qualified_name_a", "a") <= F.struct("qualified_name_b", "b")
    out = pairs.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("source_id"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("target_id"), "jaccard", (F.col("file_path_a") == F.col("file_path_b")).alias("same_file")
    )
    return top_edges(out, "source_id", [F.desc("jaccard"), F.col("target_id")], most)


# -- corpus statistics and vectors


def idf(tokens: DataFrame) -> DataFrame:
    """token, df, idf = ln(documents / df). tokens: doc, token."""
    total = tokens.agg(F.count_distinct("doc").alias("_n"))
    return tokens.groupBy("token").agg(F.count_distinct("doc").alias("df")).crossJoin(F.broadcast(total)).select("token", "df", F.log(F.col("_n") / F.col("df")).alias("idf"))  # one row


def tfidf_cosine(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, score: cosine over real vocabulary ids, for asked pairs of documents only."""
    weights = tokens.groupBy("doc", "token").agg(F.count("*").alias("tf")).join(idf(tokens), "token").select("doc", "token", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    left = pairs.join(weights.select(F.col("doc").alias("a"), "token", F.col("w").alias("wa")), "a")
    both = left.join(weights.select(F.col("doc").alias("b"), "token", F.col("w").alias("wb")), ["b", "token"])
    dots = both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    for side in ("a", "b"):
        dots = dots.join(norms.select(F.col("doc").alias(side), F.col("norm").alias(f"norm_{side}")), side)
    return dots.select("a", "b", F.coalesce(F.try_divide("dot", F.col("norm_a") * F.col("norm_b")), F.lit(0.0)).alias("score"))


#: Random index vectors: dimensions, nonzero places of a token's base vector, and the window of co-occurrence.
DIMENSIONS, NONZERO, WINDOW = 256, 8, 5


def base_vector(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """NONZERO places with 1 or -1, by hash."""
    places = F.array(*(F.struct(F.pmod(F.xxhash64(token, F.lit(i)), F.lit(dimensions)).alias("d"), F.when(F.xxhash64(token, F.lit(1000 + i)) % 2 == 0, 1.0).otherwise(-1.0).alias("v")) for i in range(NONZERO)))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(F.filter(places, lambda p: p.d == d), F.lit(0.0), lambda s, p: s + p.v))


def normalised(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(vector, lambda v: F.when(norm == 0, 0.0).otherwise(v / norm))


def _sum_vectors(rows: DataFrame, keys: list[str], dimensions: int) -> DataFrame:
    """Sums columns v (vector) and w (weight): rows are summed where they are before they are shuffled."""
    parts = [F.sum(F.col("v")[d] * F.col("w")).alias(f"_{d}") for d in range(dimensions)]
    return rows.groupBy(*keys).agg(*parts).select(*keys, F.array(*(F.col(f"_{d}") for d in range(dimensions))).alias("vector"))


def token_vectors(tokens: DataFrame, dimensions: int = 64, blend: float = 0.7, passes: int = 2) -> DataFrame:
    """token, vector: base vectors blended with those of their neighbours by 1 / distance, twice. tokens: doc, pos, token.

    Neighbours are met in one sorted pass over each document, not by a join of the tokens with themselves.
    """
    placed = tokens.filter("doc is not null and pos is not null and token is not null")
    around = Window.partitionBy("doc").orderBy("pos").rangeBetween(-WINDOW, WINDOW)
    met = placed.select("token", "pos", F.collect_list(F.struct(F.col("pos").alias("at"), F.col("token").alias("other"))).over(around).alias("near"))
    met = met.select("token", "pos", F.explode("near").alias("p")).filter("p.at <> pos")
    near = cut(met.groupBy("token", "p.other").agg(F.sum(1.0 / F.abs(F.col("p.at") - F.col("pos"))).alias("w")))
    vectors = cut(tokens.select("token").distinct().select("token", normalised(base_vector(F.col("token"), dimensions)).alias("vector")))
    for _ in range(passes):
        sums = _sum_vectors(near.join(vectors.select(F.col("token").alias("other"), F.col("vector").alias("v")), "other"), ["token"], dimensions)
        mixed = vectors.join(sums.withColumnRenamed("vector", "near"), "token", "left")
        blended = F.when(F.col("near").isNull(), F.col("vector")).otherwise(F.zip_with("vector", normalised(F.col("near")), lambda a, b: (1 - blend) * a + blend * b))
        vectors = cut(mixed.select("token", normalised(blended).alias("vector")))
    return vectors


def document_vectors(tokens: DataFrame, vectors: DataFrame, dimensions: int = 64) -> DataFrame:
    """doc, vector: the normalised sum of the tokens' vectors by idf. The same serves for callees, types and decorators."""
    rows = tokens.join(idf(tokens).select("token", F.col("idf").alias("w")), "token").join(vectors.select("token", F.col("vector").alias("v")), "token")
    return _sum_vectors(rows, ["doc"], dimensions).select("doc", normalised(F.col("vector")).alias("vector"))


def hyperplanes(dimensions: int, planes: int = 64) -> np.ndarray:
    """Fixed planes of 1 and -1, from a linear congruential rule."""
    out, x = np.empty(planes * dimensions), 7
    for i in range(len(out)):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out[i] = 1.0 if x >> 63 else -1.0
    return out.reshape(planes, dimensions)


def hyperplane_signature(vector: Column, dimensions: int, planes: int = 64) -> Column:
    """Sign bits of the products with fixed planes of 1 and -1."""
    rows = [F.array(*map(F.lit, plane.tolist())) for plane in hyperplanes(dimensions, planes)]
    dots = [F.aggregate(F.zip_with(vector, r, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v) for r in rows]
    return F.array(*((d >= 0).cast("int") for d in dots))


def hyperplane_bands(vectors: DataFrame, dimensions: int, planes: int = 64, n_bands: int = 16) -> DataFrame:
    """id, band, bucket: each run of planes / n_bands sign bits as one number. vectors: id, vector."""
    width = planes // n_bands
    bits = hyperplane_signature(F.col("vector"), dimensions, planes)
    signed = vectors.filter("vector is not null").select("id", bits.alias("bits"))
    buckets = F.array(*(F.struct(F.lit(b).alias("band"), sum((F.element_at("bits", b * width + i + 1) * (1 << i) for i in range(width)), F.lit(0)).alias("bucket")) for b in range(n_bands)))
    return signed.select("id", F.explode(buckets).alias("p")).select("id", "p.band", "p.bucket")


#: Rows of a block of vectors, and of it compared at once.
BLOCK, SLICE = 4096, 512


def banded_cosines(vectors: DataFrame, dimensions: int, least: float, planes: int = 64, n_bands: int = 16) -> DataFrame:
    """a, b, score: cosines of `least` (over 0) or more, of all pairs a < b whose signatures share a band. vectors: id, vector.

    A bucket of a few bits holds a large part of all rows. So rows are dealt into blocks, and each two blocks meet in
    one task, in place of a join of every bucket with itself; no bucket is passed over. Null vectors are in no pair.
    """
    own = vectors.filter("vector is not null").select("id", "vector", F.array_join(hyperplane_signature(F.col("vector"), dimensions, planes), "").alias("bits"))
    n = max(1, -(-vectors.count() // BLOCK))
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, block = part["id"].to_numpy(), part["block"].to_numpy()
        v = np.stack(part["vector"].to_list()).astype(float)
        norms = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)
        bits = np.frombuffer("".join(part["bits"]).encode(), np.uint8).reshape(len(part), n_bands, -1) & 1
        bands = bits @ (1 << np.arange(bits.shape[2]))
        left, right = np.flatnonzero(block == part["i"].iloc[0]), np.flatnonzero(block == part["j"].iloc[0])
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for k in range(0, len(left), SLICE):
            cosines = v[left[k : k + SLICE]] @ v[right].T
            x, y = np.nonzero(cosines >= least)
            score, x, y = cosines[x, y], left[k + x], right[y]
            keep = (bands[x] == bands[y]).any(axis=1) & ((block[x] != block[y]) | (ids[x] < ids[y]))
            out.append((np.minimum(ids[x], ids[y])[keep], np.maximum(ids[x], ids[y])[keep], score[keep]))
        return pd.DataFrame(dict(zip(("a", "b", "score"), map(np.concatenate, zip(*out)))))

    return cut(own.groupBy("i", "j").applyInPandas(run, "a bigint, b bigint, score double"))


def profile_vector(counters: list[Column]) -> Column:
    """A structural profile: counters of a node's shape as one vector, each on a logarithmic scale; missing ones count 0."""
    return F.array(*(F.log1p(F.coalesce(c.cast("double"), F.lit(0.0))) for c in counters))


def path_proximity(a: Column, b: Column) -> Column:
    """1 + 0.1 x the shared leading folders over the deeper path's folders."""

    def folders(p: Column) -> Column:
        parts = F.split(p, "/")
        return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    x, y = folders(a), folders(b)
    same = F.aggregate(F.arrays_zip(x.alias("x"), y.alias("y")), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, p: F.struct((s.n + (s.on & F.coalesce(p["x"] == p["y"], F.lit(False))).cast("int")).alias("n"), (s.on & F.coalesce(p["x"] == p["y"], F.lit(False))).alias("on")), lambda s: s.n)
    return F.lit(1.0) + F.coalesce(F.lit(0.1) * F.try_divide(same.cast("double"), F.greatest(F.size(x), F.size(y)).cast("double")), F.lit(0.0))


# The weights of the signals and the threshold of an edge.
WEIGHTS = {"tfidf": 0.20, "index": 0.25, "minhash": 0.10, "api": 0.15, "type": 0.10, "decorator": 0.05, "profile": 0.10}
SEMANTIC_THRESHOLD, CLONE = 0.75, 0.95


def combined_score(proximity: Column | None = None) -> Column:
    """From columns named as in WEIGHTS; near clones score 0, as they have an edge of their own."""
    total = reduce(lambda a, b: a + b, (F.lit(w) * F.coalesce(F.col(c), F.lit(0.0)) for c, w in WEIGHTS.items()))
    total = total if proximity is None else total * proximity
    return F.when(F.coalesce(F.col("minhash"), F.lit(0.0)) >= CLONE, 0.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def semantic_edges(pairs: DataFrame, threshold: float = SEMANTIC_THRESHOLD, budget: int = 10) -> DataFrame:
    """Edges (a, b, score) so that no node has more than `budget`, granted in order of score, then a and b.

    A pair that is among as many first ones of both its ends as these have left is granted whatever becomes of the
    others, so all such pairs are granted at once; then pairs of ends that have nothing left go, and so on. The best
    pair of all is always among them.
    """
    left = cut(pairs.filter(F.col("score") >= threshold).select("a", "b", "score"))
    granted: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select("a", "b", "score", F.explode(F.array("a", "b")).alias("id"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "a", "b"))
        first = ends.withColumn("rank", rank).filter(F.col("rank") <= budget)
        if granted:
            used = reduce(DataFrame.union, granted).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("used"))
            first = first.join(used, "id", "left").filter(F.col("rank") + F.coalesce("used", F.lit(0)) <= budget)
        granted.append(cut(first.groupBy("a", "b", "score").agg(F.count("*").alias("n")).filter("n = 2").select("a", "b", "score")))
        used = reduce(DataFrame.union, granted).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("used"))
        full = cut(used.filter(F.col("used") >= budget).select("id"))
        rest = left.join(granted[-1].select("a", "b"), ["a", "b"], "left_anti")
        for end in ("a", "b"):
            rest = rest.join(full.withColumnRenamed("id", end), end, "left_anti")
        left = cut(rest.select("a", "b", "score"))
    return reduce(DataFrame.union, granted) if granted else left


def diffuse(vectors: DataFrame, edges: DataFrame, alpha: float = 0.3, dimensions: int = 64) -> DataFrame:
    """id, vector: (1 - alpha) of the own vector and alpha of the neighbours' mean, normalised. vectors: id, vector."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).union(edges.select("target_id", "source_id"))
    near = _sum_vectors(both.join(vectors.select(F.col("id").alias("other"), F.col("vector").alias("v")), "other").withColumn("w", F.lit(1.0)), ["id"], dimensions)
    counts = both.groupBy("id").agg(F.count("*").alias("n"))
    own = vectors.join(near.withColumnRenamed("vector", "near").join(counts, "id"), "id", "left")
    mixed = F.when(F.col("near").isNull(), F.col("vector")).otherwise(F.zip_with("vector", F.transform("near", lambda v: v / F.col("n")), lambda a, b: (1 - alpha) * a + alpha * b))
    return own.select("id", normalised(mixed).alias("vector"))


# -- quantised vectors

CODE_DIMENSIONS = 1024


def rotated_codes(vectors: np.ndarray, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-bit codes (two to a byte), scales and offsets, after random signs and a Walsh-Hadamard transform."""
    n = CODE_DIMENSIONS
    x = np.zeros((len(vectors), n))
    x[:, : vectors.shape[1]] = vectors
    x *= np.random.default_rng(seed).choice([-1.0, 1.0], n)
    h = 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), axis=2).reshape(len(x), n)
        h *= 2
    x /= np.sqrt(n)
    low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    scale = np.where(high > low, (high - low) / 15, 1.0)
    codes = np.clip(np.rint((x - low) / scale), 0, 15).astype(np.uint8)
    return codes[:, ::2] | codes[:, 1::2] << 4, scale[:, 0], low[:, 0]


def code_products(a: tuple, b: tuple) -> np.ndarray:
    """Estimated inner products of two sets of codes."""

    def unpack(c: tuple) -> np.ndarray:
        codes = np.empty((len(c[0]), CODE_DIMENSIONS))
        codes[:, ::2], codes[:, 1::2] = c[0] & 15, c[0] >> 4
        return codes * c[1][:, None] + c[2][:, None]

    return unpack(a) @ unpack(b).T
