"""Ranked retrieval: BM25, exact cosine, rank fusion, token overlap and neighbour expansion.

All rankings order by score descending, then id ascending. Statistics are those of the given scope:
filter the documents first, or name scope columns to have one set of statistics per scope.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.functions.text import tokens
from quillon.session import spread

K1, B, RRF_K, QUERY_TF_CAP, CANDIDATES = 1.5, 0.75, 60, 2, 2000
#: Queries up to this many bytes of estimated size may be broadcast; beyond it Spark chooses.
BROADCAST_QUERY_TERMS = 200_000
#: Pairs of a query and a document that a task may hold the sums of.
PAIRS_A_TASK = 500_000


def document_tokens(df: DataFrame, id_col: str, *texts: Column, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope..., id, tokens) of the texts joined by a space; a text given twice counts twice."""
    text = F.concat_ws(" ", *texts) if len(texts) > 1 else F.coalesce(*texts, F.lit(""))
    return spread(df.select(*scope, F.col(id_col).alias("id"), text.alias("text"))).select(*scope, "id", tokens(F.col("text")).alias("tokens"))


def postings(docs: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope..., id, dl, term, tf) from document tokens."""
    terms = docs.select(*scope, "id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return terms.groupBy(*scope, "id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope..., n_docs, avgdl) over all documents, those without tokens included."""
    return docs.groupBy(*scope).agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) from (query_id, tokens); a term counts at most twice."""
    exploded = queries.select("query_id", F.explode("tokens").alias("term"))
    return exploded.groupBy("query_id", "term").agg(F.least(F.count("*"), F.lit(QUERY_TF_CAP)).alias("weight"))


def tasks_for(docs: DataFrame, queries: int) -> int:
    """Into how many tasks documents go so that a task's pairs with all queries stay bounded; documents are counted."""
    return max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() * queries // PAIRS_A_TASK))


def bm25(docs: DataFrame, queries: DataFrame, scope: tuple[str, ...] = (), k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, scope..., id, score) of every document that shares a term with the query.

    Scores are rounded to nine places: the order in which a shuffle adds up terms changes the last
    bits, and documents of equal text must tie. The one shuffle of token volume is the postings' aggregate, and only after terms that no query
    has are gone, so its size follows the query terms and not the corpus. The distinct query terms
    are counted first and broadcast only below a bound. Nearly every document shares a common word with every
    query, so then documents are dealt to as many tasks as keep the pairs of each bounded, whatever their bytes.
    """
    q = query_terms(queries)
    wanted = q.select("term").unionByName(q.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    n_terms, n_queries = q.agg(F.count("*"), F.count_distinct("query_id")).first()
    small = n_terms <= BROADCAST_QUERY_TERMS
    sent = F.broadcast if small else (lambda x: x)
    # every document also gives one row with the empty term, which no text has: its statistics come
    # from the same exchange as its postings. The filters below are on aggregates, so they stay above
    # that exchange, and Spark reuses it instead of cutting the texts into tokens again.
    marked = docs.select(*scope, "id", F.size("tokens").alias("dl"), F.explode(F.array_append("tokens", F.lit(""))).alias("term"))
    # dealt by document once: with the small sides broadcast, the sums per document need no other shuffle
    found = marked.join(sent(wanted), "term", "left_semi")
    tf = (found.repartition(tasks_for(docs, n_queries), "id") if small else found).groupBy(*scope, "id", "dl", "term").agg(F.count("*").alias("tf"), F.max(F.col("term") == "").alias("is_doc"))
    stats = tf.filter("is_doc").groupBy(*scope).agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    tf = tf.filter("NOT is_doc").drop("is_doc")
    # counted through tf, so that column pruning leaves this branch's exchange equal to the others
    df = tf.groupBy(*scope, "term").agg(F.sum((F.col("tf") > 0).cast("int")).alias("df"))
    rated = df.join(stats, list(scope)) if scope else df.crossJoin(F.broadcast(stats))
    rated = rated.select(*scope, "term", "avgdl", idf(F.col("n_docs").cast("double"), F.col("df")).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) * F.col("weight")
    hits = tf.join(rated if scope else sent(rated), [*scope, "term"]).join(sent(q), "term")
    return hits.groupBy("query_id", *scope, "id").agg(F.round(F.sum(part), 9).alias("score")).filter("score > 0")


def ranked(scores: DataFrame, k: int | None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds rank 1, 2, ... per query; keeps the first k (all if None)."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def row_numbers(df: DataFrame, by: tuple[str, ...], order: str, tie: str, name: str, descending: bool = False, few: int = 1_000_000, bins: int = 256) -> DataFrame:
    """Adds 1, 2, ... per ``by`` in the order of a numeric column, then of ``tie``; for groups that hold any share of all rows.

    Up to ``few`` rows, which are counted, are one window a group. More are dealt to bins by quantiles of
    the column, numbered in each, and get the size of the bins before; the table of bins is small.
    """
    n, edges = df.agg(F.count("*"), F.percentile_approx(F.col(order).cast("double"), [k / bins for k in range(1, bins)], 10_000)).first()
    way = (F.desc if descending else F.asc)(order)
    if n <= few:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(way, F.asc(tie))).cast("long"))
    below = F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))), lambda e: e < F.col(order).cast("double")))
    binned = df.withColumn("_bin", -below if descending else below)
    sizes = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(way, F.asc(tie)))
    return binned.withColumn("_own", own).join(sizes.select(*by, "_bin", before.alias("_before")), [*by, "_bin"]).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_bin", "_own", "_before")


def ranked_whole(scores: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds rank 1, 2, ... to every row, however many a query has."""
    return row_numbers(scores, by, "score", "id", "rank", descending=True)


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of a single query, without a window: one TakeOrderedAndProject."""
    return scores.orderBy(F.desc("score"), F.asc("id")).limit(k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array<double>; 0 if a norm is 0. Lengths must be equal."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0.0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def vector_problem(v: Column, dimensions: int) -> Column:
    """Why a vector is refused: empty, dimension or not_finite; null if it is fine."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNull() | (F.size(v) == 0), "empty").when(F.size(v) != dimensions, "dimension").when(bad, "not_finite")


def in_blocks(queries: DataFrame, key: str, size: int) -> list[DataFrame]:
    """Parts of a stated query set of about ``size`` rows, by the key's hash; a set of at most ``size`` is one part."""
    n = -(-queries.count() // size)
    if n < 2:
        return [queries]
    return [queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]


def cosine_scores(vectors: DataFrame, queries: DataFrame, block: int = 10_000) -> DataFrame:
    """(query_id, id, score): every vector against a stated query set (query_id, query_vector).

    Queries are counted and sent to all tasks in blocks, so what is broadcast at once stays bounded.
    """
    score = cosine(F.col("query_vector"), F.col("vector")).alias("score")
    parts = [vectors.crossJoin(F.broadcast(q)).select("query_id", "id", score) for q in in_blocks(queries, "query_id", block)]
    return reduce(DataFrame.unionByName, parts)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, bin_rows: int = 8_192, block: int = 2_048) -> DataFrame:
    """(query_id, id, score, rank): the k best vectors of every query, as ``ranked(cosine_scores(...), k)`` has them.

    For many queries: vectors are dealt to bins by their id's hash, about ``bin_rows`` in each, queries to blocks of about
    ``block``, and every bin meets every block in a task of its own, so neither table passes through the driver or one task;
    both are counted. A task gives its k best of each query, which a window ranks. Scores add up in the order of
    ``cosine``, so equal vectors tie. A null vector or entry gives a null score, which ranks last; a zero norm gives 0, and
    else a length other than the query's null.
    """
    bins, blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, bin_rows), (queries, block)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = vectors.select(deal("id", bins).alias("bin"), every(blocks).alias("block"), "id", F.col("vector").cast("array<double>").alias("vector"))
    q = queries.select(every(bins).alias("bin"), deal("query_id", blocks).alias("block"), "query_id", F.col("query_vector").cast("array<double>").alias("vector"))
    kinds = {c: df.schema[c].dataType for df, c in ((queries, "query_id"), (vectors, "id"))}
    schema = StructType([*(StructField(c, t) for c, t in kinds.items()), StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, of, score = best_cosines(left.column("vector"), right.column("vector"), left.column("id"), k)
        return pa.table([right.column("query_id").take(of), left.column("id").take(at), score], schema=arrow)

    # a number of partitions is given, as the work is in pairs and not in the bytes that would otherwise set it
    parts = bins * blocks
    sides = [df.repartition(parts, "bin", "block").groupBy("bin", "block") for df in (a, q)]
    return ranked(sides[0].cogroup(sides[1]).applyInArrow(run, schema), k)


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length, as (places, matrix); rows that are null or hold nulls are left out."""
    lists = column.combine_chunks()
    values, ends = lists.values, lists.offsets.to_numpy()
    holes = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
    whole = lists.is_valid().to_numpy(zero_copy_only=False) & (holes[ends[1:]] == holes[ends[:-1]])
    flat, size = values.fill_null(0.0).to_numpy(zero_copy_only=False), np.diff(ends)
    at = {int(n): np.flatnonzero(whole & (size == n)) for n in np.unique(size[whole])}
    return {n: (rows, flat[ends[rows][:, None] + np.arange(n)]) for n, rows in at.items()}


def best_cosines(vectors: pa.ChunkedArray, queries: pa.ChunkedArray, ids: pa.ChunkedArray, k: int, step: int = 64) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(place of the vector, place of the query, score) of the k best of every query; equal scores by id, null ones last."""
    # all columns are in the order of the ids, so that a stable sort by score breaks ties
    order = pc.sort_indices(ids).to_numpy().astype(np.int64)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    none = np.empty(0, dtype=np.int64)
    held, norms = {n: (place[at], np.ascontiguousarray(v.T)) for n, (at, v) in _matrices(vectors).items()}, np.full(len(order), np.nan)
    whole = np.zeros(len(order), dtype=bool)
    for at, v in held.values():
        norms[at], whole[at] = np.sqrt(_added(v, v)), True
    asked = _matrices(queries)
    lost = np.setdiff1d(np.arange(len(queries)), np.concatenate([none, *(rows for rows, _ in asked.values())]))
    out = [(none, none, np.empty(0), np.empty(0, dtype=bool))]
    out += [(order[:k], np.full(min(k, len(order)), row), np.zeros(min(k, len(order))), np.ones(min(k, len(order)), dtype=bool)) for row in lost]
    for n, (rows, m) in asked.items():
        at, v = held.get(n, (none, np.empty((n, 0))))
        for first in range(0, len(rows), step):
            part = np.ascontiguousarray(m[first : first + step].T)
            dot, score = np.zeros((part.shape[1], len(at))), np.zeros((part.shape[1], len(order)))
            with np.errstate(all="ignore"):
                for p, x in zip(part, v):
                    dot += p[:, None] * x
                norm = np.sqrt(_added(part, part))[:, None] * norms
                score[:, at] = np.where(norm[:, at] == 0.0, 0.0, dot / norm[:, at])
            missing = ~whole | (norm != 0.0)
            missing[:, at] = False
            # Spark has NaN above all numbers; numpy has it last
            keys = np.where(missing, np.nan, np.where(np.isnan(score), -np.inf, -score))
            for row, key, scores, null in zip(rows[first : first + step], keys, score, missing):
                edge = np.partition(key, k - 1)[k - 1] if k < len(key) else np.nan
                best = np.arange(len(key)) if np.isnan(edge) else np.flatnonzero(key <= edge)
                best = best[np.argsort(key[best], kind="stable")][:k]
                out.append((order[best], np.full(len(best), row), scores[best], null[best]))
    at, of, score, missing = (np.concatenate(c) for c in zip(*out))
    return pa.array(at), pa.array(of), pa.array(score, mask=missing)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Column sums of products, added from the first row on, as ``cosine`` adds an array's entries."""
    out = np.zeros(a.shape[1])
    with np.errstate(all="ignore"):
        for x, y in zip(a, b):
            out += x * y
    return out


def fuse(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists: the sum of 1 / (k + rank)."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    out = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        out = out.unionByName(r.select("query_id", "id", "rank"))
    return out.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def token_overlap(docs: DataFrame, queries: DataFrame, least: int = 2, k: int = 3) -> DataFrame:
    """(query_id, id, score, rank): shared distinct tokens, at least ``least``, best k.

    By an equi-join on the token, so only pairs that share one are formed. The distinct query terms are counted and
    broadcast below a bound; documents are then dealt to as many tasks as keep the pairs of each bounded.
    """
    a = docs.select("id", F.explode(F.array_distinct("tokens")).alias("term"))
    q = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    n_terms, n_queries = q.agg(F.count("*"), F.count_distinct("query_id")).first()
    if n_terms <= BROADCAST_QUERY_TERMS:
        a = a.join(F.broadcast(q.select("term").distinct()), "term", "left_semi").repartition(tasks_for(docs, n_queries), "id")
        q = F.broadcast(q)
    scores = a.join(q, "term").groupBy("query_id", "id").agg(F.count("*").alias("score")).filter(F.col("score") >= least)
    return ranked(scores, k)


def neighbours(chunks: DataFrame, parent: tuple[str, ...], section: tuple[str, ...], order: str, item: str) -> DataFrame:
    """Adds prev/next item within the parent and within the section."""
    p, s = Window.partitionBy(*parent).orderBy(order), Window.partitionBy(*section).orderBy(order)
    return chunks.withColumns({
        "parent_prev": F.lag(item).over(p),
        "parent_next": F.lead(item).over(p),
        "section_prev": F.lag(item).over(s),
        "section_next": F.lead(item).over(s),
    })


def neighbour_list(*candidates: Column) -> Column:
    """Neighbours in the order given, nulls and repeats left out."""
    return F.array_distinct(F.array_compact(F.array(*candidates)))


def within_budget(ranking: DataFrame, budget: int = 2) -> DataFrame:
    """Per query, neighbours that the ranked rows take in rank order until the budget is used.

    ``ranking`` has query_id, rank, id and neighbours; a taken neighbour is not taken again, a ranked
    item may be. The rows of a query are few (the ranking's limit), so they fold in one expression.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "neighbours")))
    per_query = ranking.groupBy("query_id").agg(rows.alias("rows"))
    def take(taken: Column, row: Column) -> Column:
        new = F.array_except(row["neighbours"], taken["all"])
        new = F.slice(new, 1, F.greatest(F.lit(0), budget - F.size(taken["all"])))
        return F.struct(F.concat(taken["all"], new).alias("all"), F.array_append(taken["out"], F.struct(row["id"].alias("id"), new.alias("taken"))).alias("out"))

    kind = dict(ranking.dtypes)["id"]
    start = F.struct(F.array().cast(f"array<{kind}>").alias("all"), F.array().cast(f"array<struct<id:{kind},taken:array<{kind}>>>").alias("out"))
    folded = per_query.select("query_id", F.explode(F.aggregate("rows", start, take, lambda t: t["out"])).alias("x"))
    return folded.select("query_id", "x.id", "x.taken")


def evidence_search(chunks: DataFrame, query: str, limit: int = 5, source_type: str | None = None, source_id: str | None = None, method: str = "bm25", query_vector: list[float] | None = None, max_chunks: int | None = 50_000) -> tuple[str, DataFrame | None]:
    """(status, ranking) over active chunks.

    ``chunks``: chunk_id, source_type, source_id, title, text, retrieval_text, status, current_sha256,
    content_sha256, vector. Order of outcomes: argument errors, corpus_limit_exceeded, no_results,
    embeddings_missing, ok. A ranking is never cut short silently; without ``max_chunks`` all chunks are searched.
    """
    words = " ".join(query.split())
    if not 1 <= len(words) <= 256:
        raise ValueError("query must have 1 to 256 characters")
    if not 1 <= limit <= 8:
        raise ValueError("limit must be 1 to 8")
    if method not in ("bm25", "dense", "hybrid"):
        raise ValueError("unknown method")
    if method != "bm25" and not query_vector:
        raise ValueError("a query vector is needed")
    active = scoped(chunks.filter("status = 'approved' AND current_sha256 = content_sha256"), source_type, source_id)
    n = active.limit(1 if max_chunks is None else max_chunks + 1).count()
    if max_chunks is not None and n > max_chunks:
        return "corpus_limit_exceeded", None
    if not n:
        return "no_results", None
    spark = chunks.sparkSession
    if method != "bm25":
        if active.filter(F.col("vector").isNull()).limit(1).count():
            return "embeddings_missing", None
        q = spark.createDataFrame([(0, [float(x) for x in query_vector])], "query_id int, query_vector array<double>")
        dense = cosine_scores(active.select(F.col("chunk_id").alias("id"), F.col("vector").cast("array<double>").alias("vector")), q)
        # rounded, as the order of additions changes the last bits and equal chunks must tie by id
        dense = dense.withColumn("score", F.round("score", 12))
        dense = ranked_whole(dense) if method == "hybrid" else dense
    if method != "dense":
        docs = document_tokens(active, "chunk_id", F.col("title"), F.coalesce("retrieval_text", "text"))
        asked = spark.createDataFrame([(0, words)], "query_id int, q string").select("query_id", tokens(F.col("q")).alias("tokens"))
        sparse = ranked(bm25(docs, asked), CANDIDATES)
    scores = sparse if method == "bm25" else dense if method == "dense" else fuse([sparse, dense]).withColumn("score", F.round("score", 12))
    best = top(scores.select("id", "score"), limit).withColumn("score", F.round("score", 6))
    # at most eight rows: the search runs once, and what it found tells the status
    rows = best.collect()
    return ("ok" if rows else "no_results"), spark.createDataFrame(rows, best.schema)


def scoped(df: DataFrame, source_type: str | None = None, source_id: str | None = None) -> DataFrame:
    """Rows of a source type, or of one source; a source id needs its type."""
    if source_id is not None and source_type is None:
        raise ValueError("source_id needs source_type")
    if source_type is not None:
        df = df.filter(F.col("source_type") == source_type)
    return df if source_id is None else df.filter(F.col("source_id") == source_id)


def evidence_scan(documents: DataFrame, versions: DataFrame, chunks: DataFrame, embeddings: DataFrame, elements: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Chunks of approved documents' current versions, with the version's and the chunk's columns, ``vector``
    and ``element``.

    A vector counts only if it is of the model, has its dimensions and is not normalised; a chunk's
    element is one of its own version. Both are null where there is none, so no chunk is lost.
    """
    key = ["source_type", "source_id", "content_sha256"]
    current = documents.filter("status = 'approved'").select("source_type", "source_id", F.col("current_sha256").alias("content_sha256"))
    active = chunks.join(versions.join(current, key), key)
    usable = embeddings.filter((F.col("model") == model) & (F.col("dimensions") == dimensions) & (F.col("normalization") == "none")).select("chunk_id", "vector")
    return active.join(usable, "chunk_id", "left").join(elements.select(*key, "element_id", "element"), [*key, "element_id"], "left")


def embedding_input(documents: DataFrame, versions: DataFrame, chunks: DataFrame, most: int = 50_000) -> DataFrame:
    """(chunk_id, content_sha256, text) of all active chunks; more than ``most`` are refused, as an index takes all or none."""
    key = ["source_type", "source_id", "content_sha256"]
    current = documents.filter("status = 'approved'").select("source_type", "source_id", F.col("current_sha256").alias("content_sha256"))
    out = chunks.join(versions.join(current, key).select(*key), key).select("chunk_id", "content_sha256", F.coalesce("retrieval_text", "text").alias("text"))
    if out.limit(most + 1).count() > most:
        raise ValueError("the corpus has too many chunks")
    return out


def utf8_prefix(c: Column, limit: Column | int) -> Column:
    """The longest prefix of whole characters within a number of bytes."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    cut = lambda k: F.try_validate_utf8(F.substring(F.encode(c, "UTF-8"), F.lit(1), F.greatest(F.lit(0), limit - k)).cast("string"))
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.coalesce(*[cut(k) for k in range(4)]))


def retrieval_text(path: Column, text: Column, limit: int = 1800) -> Column:
    """A chunk's text after as much of its section path as the byte limit leaves room for; the text stays whole."""
    prefix = F.rtrim(utf8_prefix(F.array_join(path, " / "), F.greatest(F.lit(0), limit - F.octet_length(text) - 1)))
    return F.when(F.coalesce(prefix, F.lit("")) == "", text).otherwise(F.concat(prefix, F.lit("\n"), text))


def bounded_join(parts: Column, limit: int = 5600) -> Column:
    """Parts joined by newlines up to a number of bytes; the last may be cut, and nothing follows a cut one."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))

    def step(acc, part):
        glue = F.when(acc["text"] == "", "").otherwise("\n")
        room = limit - F.octet_length(acc["text"]) - F.length(glue)
        piece = utf8_prefix(part, room)
        stop = acc["full"] | (room <= 0) | (piece == "")
        return F.struct(F.when(stop, acc["text"]).otherwise(F.concat(acc["text"], glue, piece)).alias("text"), (stop | (piece != part)).alias("full"))

    return F.aggregate(F.filter(parts, lambda p: p.isNotNull()), start, step, lambda acc: acc["text"])


def expanded(best: DataFrame, chunks: DataFrame, budget: int = 2, limit: int = 5600) -> DataFrame:
    """The ranked chunks (id, score, rank; at most 8) as evidence items with neighbours and context.

    ``chunks``: chunk_id, ordinal, parent, section, text, retrieval_text, evidence_text; ``parent`` names
    the chunk's element within its document and is null where it has none, ``section`` its document and
    section. Only chunks with a parent have neighbours. They are looked up among the hits' parents and
    sections alone; the hits are few, so they are sent to all tasks.
    """
    hits = F.broadcast(best.select(F.col("id").alias("chunk_id"), "score", "rank"))
    of = chunks.join(hits, "chunk_id")
    wanted = of.select(F.explode(F.array_compact(F.array(F.struct(F.lit("p").alias("kind"), F.col("parent").alias("key")), F.struct(F.lit("s").alias("kind"), F.when(F.col("parent").isNotNull(), F.col("section")).alias("key"))))).alias("w")).select("w.*").filter("key IS NOT NULL").distinct()
    near = chunks.filter("parent IS NOT NULL")
    near = near.select("chunk_id", "ordinal", "text", "retrieval_text", "evidence_text", F.explode(F.array(F.struct(F.lit("p").alias("kind"), F.col("parent").alias("key")), F.struct(F.lit("s").alias("kind"), F.col("section").alias("key")))).alias("w")).select("*", "w.*").join(F.broadcast(wanted), ["kind", "key"], "left_semi")
    w = Window.partitionBy("kind", "key").orderBy("ordinal")
    item = F.struct("chunk_id", "ordinal", F.coalesce("retrieval_text", "text").alias("shown"), F.coalesce("evidence_text", "text").alias("excerpt"))
    sides = near.select("chunk_id", "kind", F.lag(item).over(w).alias("prev"), F.lead(item).over(w).alias("next"))
    sides = sides.join(F.broadcast(best.select(F.col("id").alias("chunk_id"))), "chunk_id", "left_semi")
    listed = sides.groupBy("chunk_id").agg(*[F.first(F.when(F.col("kind") == k, F.col(c)), ignorenulls=True).alias(f"{k}_{c}") for k in "ps" for c in ("prev", "next")])
    around = of.join(listed, "chunk_id", "left").withColumn("around", F.array_compact(F.array("p_prev", "p_next", "s_prev", "s_next")))
    ranking = around.select(F.lit(0).alias("query_id"), "rank", F.col("chunk_id").alias("id"), F.array_distinct(F.transform("around", lambda x: x["chunk_id"])).alias("neighbours"))
    taken = within_budget(ranking, budget).select(F.col("id").alias("chunk_id"), "taken")
    out = around.join(F.broadcast(taken), "chunk_id")
    mine = F.filter(F.array_distinct("around"), lambda x: F.array_contains("taken", x["chunk_id"]))
    own = F.struct("chunk_id", "ordinal", F.coalesce("retrieval_text", "text").alias("shown"), F.coalesce("evidence_text", "text").alias("excerpt"))
    rows = F.array_sort(F.transform(F.array_append(F.col("mine"), F.col("own")), lambda x: F.struct(x["ordinal"], x["chunk_id"], x["shown"])))
    out = out.withColumns({"mine": mine, "own": own})
    order = F.transform("taken", lambda t: F.filter("mine", lambda x: x["chunk_id"] == t)[0])
    return out.select("rank", "chunk_id", F.round("score", 6).alias("score"), "own.excerpt", bounded_join(F.transform(rows, lambda x: x["shown"]), limit).alias("context"), F.transform(order, lambda x: F.struct(x["chunk_id"], x["excerpt"])).alias("expanded_evidence"))
