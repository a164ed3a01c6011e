"""Search over nodes, texts and vectors."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .lineage import cut
from .similarity import hyperplanes
from .traverse import SEARCH_TYPES, degrees


@dataclass(frozen=True)
class Search:
    """What structural search asks for; empty texts and None ask for nothing."""

    label: str = ""
    exclude_labels: tuple[str, ...] = ()
    name: str = ""
    qualified_name: str = ""
    file: str = ""
    relationship: str = ""
    direction: str = "any"
    min_degree: int | None = None
    max_degree: int | None = None
    exclude_entry_points: bool = False
    case_sensitive: bool = False
    sort: str = "name"  # name, degree, relevance
    limit: int | None = 10
    offset: int = 0
    types: list[str] = field(default_factory=lambda: list(SEARCH_TYPES))


def structural(nodes: DataFrame, edges: DataFrame, ask: Search) -> DataFrame:
    """All hits (before paging) with in_degree, out_degree and degree."""
    out = nodes
    if ask.label:
        out = out.filter(F.col("label") == ask.label)
    if ask.exclude_labels:
        out = out.filter(~F.col("label").isin(*ask.exclude_labels))
    for column, pattern in (("name", ask.name), ("qualified_name", ask.qualified_name)):
        if pattern:
            for hint in scalar.like_hints(pattern) if ask.case_sensitive else []:
                out = out.filter(F.col(column).contains(hint))  # cheaper than the pattern, and files know it
            out = out.filter(F.col(column).rlike(pattern if ask.case_sensitive else scalar.ignore_case(pattern)))
    if ask.file:
        like = scalar.glob_to_like(ask.file)
        like = like if "%" in like or "_" in like and "?" in ask.file else f"%{like}%"
        out = out.filter(F.col("file_path").like(like) if ask.case_sensitive else F.col("file_path").ilike(like))
    if ask.relationship:
        own = edges.filter(F.col("type") == ask.relationship)
        ends = {"outbound": ["source_id"], "inbound": ["target_id"], "any": ["source_id", "target_id"]}[ask.direction]
        ids = reduce(DataFrame.union, [own.select(F.col(e).alias("id")) for e in ends]).distinct()
        out = out.join(ids, "id", "left_semi")
    used = degrees(out, edges, ask.types)
    out = out.join(used, "id").withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    if ask.min_degree is not None:
        out = out.filter(F.col("degree") >= ask.min_degree)
    if ask.max_degree is not None:
        out = out.filter(F.col("degree") <= ask.max_degree)
    if ask.exclude_entry_points:
        calls = degrees(out, edges, ["CALLS"]).select("id", F.col("in_degree").alias("_in"), F.col("out_degree").alias("_out"))
        out = out.join(calls, "id").filter("not (_in = 0 and _out > 0)").drop("_in", "_out")
    return out


def page(hits: DataFrame, ask: Search) -> DataFrame:
    """One page in canonical order: name, qualified name, project, id; by degree or relevance, the most used first."""
    order: list[Column] = [] if ask.sort == "name" else [F.desc("degree")]
    out = hits.orderBy(*order, "name", "qualified_name", "project", "id")
    out = out.offset(ask.offset) if ask.offset else out
    return out if ask.limit is None else out.limit(ask.limit)


def paged(hits: DataFrame, ask: Search) -> tuple[DataFrame, int]:
    """A page and the exact number of all hits before paging."""
    return page(hits, ask), hits.count()


def scope(projects: DataFrame, selectors: list[str]) -> list[str]:
    """The projects that the selectors name, in order; `*` is all that are ready and healthy.

    projects: project, selector, ready, healthy. A selector that names none, several, or one that is not ready raises ValueError.
    """
    rows = projects.select("project", "selector", "ready", "healthy").collect()  # a row for each project
    if "*" in selectors:
        return sorted(r.project for r in rows if r.ready and r.healthy)
    out = []
    for s in dict.fromkeys(selectors):
        found = [r for r in rows if s in (r.project, r.selector)]
        if len(found) != 1:
            raise ValueError(f"{s} names {len(found)} projects")
        if not (found[0].ready and found[0].healthy):
            raise ValueError(f"{s} is not ready")
        out.append(found[0].project)
    return sorted(set(out))


def structural_in(nodes: DataFrame, edges: DataFrame, projects: list[str], ask: Search) -> tuple[DataFrame, int]:
    """Structural search over several projects at once: sorted and paged once, with the exact total."""
    own, links = (df.filter(F.col("project").isin(projects)) for df in (nodes, edges))
    return paged(structural(own, links, ask), ask)


def full_text_in(nodes: DataFrame, query: str, projects: list[str], file_glob: str = "", limit: int = 10, offset: int = 0) -> tuple[DataFrame, int]:
    """A page of full-text hits over several projects, best first, with the exact total."""
    hits = cut(full_text(nodes, query, file_glob, projects))
    found = hits.orderBy("rank", "qualified_name", "id")
    return (found.offset(offset) if offset else found).limit(limit), hits.count()


def connected_names(nodes: DataFrame, edges: DataFrame, hits: DataFrame, limit: int = 10) -> DataFrame:
    """id, callers, callees: up to `limit` neighbour names of each hit, in order of name."""
    names = nodes.select(F.col("id").alias("other"), "name")
    parts = []
    for side, here, there in (("callers", "target_id", "source_id"), ("callees", "source_id", "target_id")):
        own = edges.filter("type = 'CALLS'").select(F.col(here).alias("id"), F.col(there).alias("other"))
        own = own.join(hits.select("id"), "id", "left_semi").join(names, "other").select("id", "name").distinct()
        first = own.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy("name"))).filter(F.col("_rank") <= limit)
        parts.append(first.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias(side)))
    empty = F.array().cast("array<string>")
    out = hits.select("id").join(parts[0], "id", "left").join(parts[1], "id", "left")
    return out.select("id", F.coalesce("callers", empty).alias("callers"), F.coalesce("callees", empty).alias("callees"))


# -- full text

#: The ranking's parameters, its boosts by label, and labels that are not searched.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
BOOSTS = {"Function": 10, "Method": 10, "Route": 8, "Class": 5, "Interface": 5, "Type": 5, "Enum": 5}
UNSEARCHED = ("File", "Folder", "Module", "Section", "Variable", "Project")
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def terms(text: Column) -> Column:
    """Lower-case words without accents."""
    return F.filter(F.split(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(docs: DataFrame, query: str, text: Column, key: str = "id") -> DataFrame:
    """key, score of every document with a word of the query; more is better.

    Only the query's words are counted: one pass over the texts for their counts and lengths, which are written, and
    small sums over those.
    """
    words = sorted({w for w in _plain_words(query)})
    if not words:
        return docs.select(key).limit(0).withColumn("score", F.lit(0.0))
    every = docs.select(key, terms(text).alias("_terms"))
    counts = [F.size(F.filter("_terms", _equals(w))).alias(f"_tf{i}") for i, w in enumerate(words)]
    rows = cut(every.select(key, F.size("_terms").alias("_size"), *counts))
    sums = rows.agg(F.count("*").alias("_n"), F.avg("_size").alias("_mean"), *(F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"_df{i}") for i in range(len(words))))
    hits = rows.filter(reduce(lambda a, b: a | b, (F.col(f"_tf{i}") > 0 for i in range(len(words))))).crossJoin(F.broadcast(sums))  # one row
    length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.try_divide(F.col("_size"), F.col("_mean")))
    parts = []
    for i in range(len(words)):
        tf, df = F.col(f"_tf{i}").cast("double"), F.col(f"_df{i}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        parts.append(idf * tf * (K1 + 1) / (tf + length))
    return hits.select(key, reduce(lambda a, b: a + b, parts).alias("score"))


def _equals(word: str):
    return lambda t: t == word


def _plain_words(query: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^\w]+|_", query.lower().translate(str.maketrans(_ACCENTED, _PLAIN))) if w]


def full_text(nodes: DataFrame, query: str, file_glob: str = "", projects: list[str] | None = None) -> DataFrame:
    """Nodes with rank (less is better): BM25 over four fields, minus a boost for the label; in canonical order."""
    own = nodes.filter(~F.col("label").isin(*UNSEARCHED))
    if file_glob:
        own = own.filter(F.col("file_path").like(scalar.glob_to_like(file_glob)))
    if projects is not None:
        own = own.filter(F.col("project").isin(projects))
    text = F.concat_ws(" ", "name", "qualified_name", "label", "file_path")
    found = bm25(own, query, text)
    boost = F.lit(0)
    for label, b in BOOSTS.items():
        boost = F.when(F.col("label") == label, b).otherwise(boost)
    return own.join(found, "id").withColumn("rank", -F.col("score") - boost).orderBy("rank", "qualified_name", "id")


# -- vectors


def query_vector(token_vectors: DataFrame, words: list[str]) -> list[float] | None:
    """The sum of the words' vectors, each by its idf: a single vector, whatever the table's size."""
    rows = token_vectors.filter(F.col("token").isin([w.lower() for w in words]))
    sums = rows.select(F.posexplode("vector").alias("d", "v"), "idf").groupBy("d").agg(F.sum(F.col("v") * F.col("idf")).alias("v")).orderBy("d").collect()
    return [r.v for r in sums] or None


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, score of the k nearest by cosine; ties go by key. The query travels as a literal, the table is scanned once."""
    wanted = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, scalar.cosine(F.col(column), wanted).alias("score")).orderBy(F.desc("score"), key).limit(k)


def vector_search_many(vectors: DataFrame, queries: dict[str, list[float]], projects: list[str] | None = None, k: int = 10) -> DataFrame:
    """node_id, project, score: the best score over several query vectors; vectors of another length are refused."""
    own = vectors if projects is None else vectors.filter(F.col("project").isin(projects))
    sizes = {r[0] for r in own.select(F.size("vector")).distinct().limit(2).collect()} | {len(q) for q in queries.values()}
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
    scores = [scalar.cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in q))) for q in queries.values()]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return own.select("node_id", "project", best.alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


#: Vectors of a block, which is compared with all queries at once.
SCANNED = 4096


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query, id, score, rank: the k nearest vectors of each query by cosine; ties go to the smaller id.

    vectors, queries: id, vector. The queries, a stated set, are dealt into blocks; each block goes past all vectors,
    and a task hands on no more than k rows for each query of a batch. Null vectors are near none.
    """
    rows = queries.filter("vector is not null").orderBy("id")
    blocks = max(1, -(-queries.count() // SCANNED))
    parts = []
    for i in range(blocks):
        taken = rows.offset(i * SCANNED).limit(SCANNED).collect()  # SCANNED vectors
        if taken:
            parts.append(_scanned(vectors, [r.id for r in taken], np.array([r.vector for r in taken], np.float64), k))
    if not parts:
        return queries.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    best = reduce(DataFrame.union, parts)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def _unit(v: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)


def _scanned(vectors: DataFrame, names: list[int], wanted: np.ndarray, k: int) -> DataFrame:
    taken = vectors.sparkSession.sparkContext.broadcast((np.array(names, np.int64), _unit(wanted)))

    def run(batches):
        ids, asked = taken.value
        best_id, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for batch in batches:
            for a in range(0, batch.num_rows, SCANNED):
                part = batch.slice(a, SCANNED)
                lists = part.column(1)
                v = _unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1))
                score = np.concatenate([best, np.round(asked @ v.T, 12)], axis=1)
                near = np.concatenate([best_id, np.broadcast_to(part.column(0).to_numpy(), (len(ids), len(lists)))], axis=1)
                order = np.lexsort((near, -score), axis=1)[:, :k]
                best, best_id = np.take_along_axis(score, order, 1), np.take_along_axis(near, order, 1)
        n = best.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best_id.ravel()), pa.array(best.ravel())], ["query", "id", "score"])

    return vectors.filter("vector is not null").select("id", "vector").mapInArrow(run, "query bigint, id bigint, score double")


def two_stage(vectors: DataFrame, queries: DataFrame, k: int = 10, prefetch: int = 400, planes: int = 256) -> DataFrame:
    """query, id, score, rank: like nearest, but from codes: the sign bits of fixed planes choose `prefetch` vectors of each
    query, whose exact cosines then decide.

    The codes of all vectors are compared, so none is left out by its place; with prefetch at the number of vectors the
    result is the exact one. Recall is a matter of the two parameters and is measured in the tests.
    """
    dimensions = len(vectors.filter("vector is not null").head()["vector"])
    plane = hyperplanes(dimensions, planes)
    rows = queries.filter("vector is not null").orderBy("id")
    parts = []
    for i in range(max(1, -(-queries.count() // SCANNED))):
        taken = rows.offset(i * SCANNED).limit(SCANNED).collect()  # SCANNED vectors
        if not taken:
            continue
        wanted = np.array([r.vector for r in taken], np.float64)
        told = vectors.sparkSession.sparkContext.broadcast((np.array([r.id for r in taken], np.int64), _unit(wanted), np.packbits(wanted @ plane.T >= 0, axis=1), plane))

        def run(batches, told=told):
            ids, asked, codes, plane = told.value
            kept = [np.zeros((len(ids), 0), t) for t in (np.int64, np.int64, np.float64)]  # distance, id, cosine
            for batch in batches:
                for a in range(0, batch.num_rows, SCANNED):
                    part = batch.slice(a, SCANNED)
                    lists = part.column(1)
                    v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
                    own = np.packbits(v @ plane.T >= 0, axis=1)
                    distance = np.zeros((len(ids), len(v)), np.int64)
                    for b in range(own.shape[1]):
                        distance += np.bitwise_count(codes[:, b, None] ^ own[None, :, b])
                    names = np.broadcast_to(part.column(0).to_numpy(), distance.shape)
                    first = np.lexsort((names, distance), axis=1)[:, :prefetch]
                    exact = np.round(np.einsum("qd,qkd->qk", asked, _unit(v)[first]), 12)
                    new = (np.take_along_axis(distance, first, 1), np.take_along_axis(names, first, 1), exact)
                    both = [np.concatenate(x, axis=1) for x in zip(kept, new)]
                    order = np.lexsort((both[1], both[0]), axis=1)[:, :prefetch]
                    kept = [np.take_along_axis(x, order, 1) for x in both]
            n = kept[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), *(pa.array(x.ravel()) for x in kept)], ["query", "distance", "id", "score"])

        parts.append(vectors.filter("vector is not null").select("id", "vector").mapInArrow(run, "query bigint, distance bigint, id bigint, score double"))
    if not parts:
        return nearest(vectors, queries, k)
    near = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    chosen = reduce(DataFrame.union, parts).withColumn("near", near).filter(F.col("near") <= prefetch)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return chosen.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "id", "score", "rank")


def search_projects(vectors: DataFrame, token_vectors: DataFrame, words: list[str], projects: list[str], k: int = 10) -> DataFrame:
    """node_id, project, score of keywords over several projects, whose token vectors must come from one model.

    vectors: node_id, project, vector, model; token_vectors: project, token, vector, idf, model.
    """
    own, tokens = (df.filter(F.col("project").isin(projects)) for df in (vectors, token_vectors))
    models = [r.model for r in own.select("model").union(tokens.select("model")).distinct().limit(2).collect()]
    if len(models) > 1:
        raise ValueError(f"vectors of different models: {sorted(map(str, models))}")
    query = query_vector(tokens, words)
    if query is None:
        return own.select("node_id", "project", F.lit(0.0).alias("score")).limit(0)
    return vector_search_many(own, {" ".join(words): query}, None, k)


# -- source text


def code_search(files: DataFrame, nodes: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """file_path, line, text and the innermost symbol around each matching line. files: file_path, content."""
    lines = files.select("file_path", F.posexplode(F.split("content", "\n")).alias("_i", "text")).select("file_path", (F.col("_i") + 1).alias("line"), "text")
    hits = lines.filter(F.col("text").rlike(pattern) if regex else F.col("text").contains(pattern))
    own = nodes.filter(~F.col("label").isin("Module", "Package", "File", "Folder")).select(F.col("file_path").alias("_f"), "id", "qualified_name", "start_line", "end_line")
    around = hits.join(own, (F.col("file_path") == F.col("_f")) & (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")), "left")
    inner = F.min_by(F.struct("id", "qualified_name"), F.struct(F.col("end_line") - F.col("start_line"), "id")).alias("symbol")
    return around.groupBy("file_path", "line", "text").agg(inner).select("file_path", "line", "text", "symbol.id", "symbol.qualified_name").orderBy("file_path", "line")


def snippet(files: DataFrame, nodes: DataFrame, qualified_name: str) -> DataFrame:
    """The lines of the symbol, by its qualified name or its end behind a dot."""
    own = nodes.filter((F.col("qualified_name") == qualified_name) | F.col("qualified_name").endswith("." + qualified_name))
    lines = F.slice(F.split("content", "\n"), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    return own.join(files, "file_path").select("id", "qualified_name", F.array_join(lines, "\n").alias("source"))
