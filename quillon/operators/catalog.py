"""The versioned catalogue: upsert, versions, snapshots, time travel, links, paging, deletion.

Plain Parquet has no MERGE, so each operator gives the new state of a table as a DataFrame; writers
put data first and the small pointer table last, which is the commit point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import ascii_lower, author_id
from quillon.operators.verify import bound


def upsert_current(current: DataFrame, incoming: DataFrame, key: str, payload: list[str], seen: str = "seen_at") -> DataFrame:
    """The current table after an import: new payload, first_seen_at kept, last_seen_at moved.

    ``incoming`` has key, payload and the import time; its last row per key counts.
    """
    latest = incoming.groupBy(key).agg(F.max_by(F.struct(*payload), seen).alias("new"), F.min(seen).alias("first_in"), F.max(seen).alias("last_in"))
    old = current.select(key, F.struct(*payload).alias("old"), "first_seen_at", "last_seen_at")
    both = old.join(latest, key, "full")
    row = F.coalesce("new", "old")
    return both.select(key, *[row[p].alias(p) for p in payload], F.coalesce("first_seen_at", "first_in").alias("first_seen_at"), F.greatest("last_seen_at", "last_in").alias("last_seen_at"))


def append_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is new, each key once."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def import_summary(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """One row: received, new_works, new_versions, unchanged."""
    keys = existing.select(key).distinct().withColumn("known", F.lit(1))
    versions = existing.select(key, version).distinct().withColumn("same", F.lit(1))
    marked = incoming.join(keys, key, "left").join(versions, [key, version], "left")
    count = lambda c: F.count(F.when(c, 1))
    return marked.agg(
        F.count("*").alias("received"),
        F.count_distinct(F.when(F.col("known").isNull(), F.col(key))).alias("new_works"),
        F.count_distinct(F.when(F.col("same").isNull(), F.struct(key, version))).alias("new_versions"),
        count(F.col("same").isNotNull()).alias("unchanged"),
    )


def membership(snapshots: DataFrame, items: str) -> DataFrame:
    """(snapshot_id, result_position, item): 0-based places of a snapshot's records."""
    return snapshots.select("snapshot_id", F.posexplode(items).alias("result_position", "item"))


def latest_per_key(versions: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last version of each key by one aggregate, not a window over all versions."""
    return versions.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in values])


def time_travel(items: DataFrame, versions: DataFrame, snapshot_id: int) -> DataFrame:
    """The records of a snapshot as they were then: membership joined to immutable versions."""
    return items.filter(F.col("snapshot_id") == snapshot_id).join(versions, ["key", "payload_sha256"]).orderBy("result_position")


def unique_crosswalk(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """New one-to-one links (left_id, right_id, norm) on an equal normal key.

    Accepted only if the right side has exactly one candidate on the left, and neither side is linked
    yet or taken earlier in the batch (by position). Null keys never match.
    """
    one = left.filter("norm IS NOT NULL").groupBy("norm").agg(F.count("*").alias("n"), F.min("left_id").alias("left_id")).filter("n = 1")
    pairs = right.filter("norm IS NOT NULL").join(one, "norm")
    pairs = pairs.join(links.select("left_id"), "left_id", "left_anti").join(links.select("right_id"), "right_id", "left_anti")
    first = pairs.withColumns({
        "a": F.row_number().over(Window.partitionBy("left_id").orderBy("position", "right_id")),
        "b": F.row_number().over(Window.partitionBy("right_id").orderBy("position", "left_id")),
    })
    return first.filter("a = 1 AND b = 1").select("left_id", "right_id", "norm")


def frozen_match(items: DataFrame, wanted: DataFrame, newest: int = 100) -> DataFrame:
    """Snapshots whose id set equals ``wanted`` (key, sha) and whose hashes all agree, newest first.

    Relational division by counting; the limit on snapshots is the search's own.
    """
    n = wanted.agg(F.count("*").alias("wanted"))
    marked = items.join(wanted.withColumnRenamed("sha", "want_sha"), "key", "left")
    per = marked.groupBy("snapshot_id").agg(F.count("*").alias("items"), F.count(F.when(F.col("sha") == F.col("want_sha"), 1)).alias("same"))
    return per.crossJoin(F.broadcast(n)).filter("items = wanted AND same = wanted").select("snapshot_id").orderBy(F.desc("snapshot_id")).limit(newest)


def unique_remap(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(old_id, new_id, mapped): a chunk's id in a new index version, if its content is there once.

    Unmapped chunks keep their id. Null key parts never match.
    """
    once = new.groupBy(*keys).agg(F.count("*").alias("n"), F.min("new_id").alias("new_id")).filter("n = 1").drop("n")
    return old.join(once, keys, "left").select("old_id", F.coalesce("new_id", "old_id").alias("new_id"), F.col("new_id").isNotNull().alias("mapped"))


def delete_with_tombstone(tables: dict[str, DataFrame], doomed: DataFrame, keys: list[str], reason: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the doomed keys, and the tombstones to append."""
    words = " ".join(reason.split())
    if not 3 <= len(words) <= 500:
        raise ValueError("a reason has 3 to 500 characters")
    left = {name: t.join(doomed.select(*keys), keys, "left_anti") for name, t in tables.items()}
    first = next(iter(tables.values()))
    return left, first.join(doomed.select(*keys), keys, "left_semi").select(*keys).distinct().withColumn("reason", F.lit(words))


def withdrawn(tables: dict[str, DataFrame], links: list[tuple[str, str, dict[str, str]]], root: str, doomed: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(left, gone): every table without, and with only, the rows that go when the doomed rows of the root go.

    ``links``: (child, parent, {child column: parent column}), a child's foreign key; a child may have several parents,
    and one that goes takes it along. ``doomed`` has key columns of the root. The tables are walked from the root along
    their keys; each is one plan of key joins. Null keys match nothing. Tables that no link reaches stay whole.
    """
    order, open_ = [root], {name for c, p, _ in links for name in (c, p)} - {root}
    while open_:
        ready = sorted(t for t in open_ if all(p in order for c, p, _ in links if c == t))
        if not ready:
            raise ValueError(f"the keys of {sorted(open_)} go in a circle")
        order += ready
        open_ -= set(ready)
    keys = doomed.columns
    gone = {root: tables[root].join(doomed.distinct(), keys, "left_semi")}
    left = dict(tables) | {root: tables[root].join(doomed.distinct(), keys, "left_anti")}
    for name in order[1:]:
        rest, taken = tables[name], None
        for parent, key in [(p, k) for c, p, k in links if c == name and p in gone]:
            ids = gone[parent].select(*[F.col(b).alias(a) for a, b in key.items()]).distinct()
            part = rest.join(ids, list(key), "left_semi").select(tables[name].columns)
            taken = part if taken is None else taken.unionByName(part)
            rest = rest.join(ids, list(key), "left_anti").select(tables[name].columns)
        if taken is not None:
            gone[name], left[name] = taken, rest
    return left, gone


def replace_embeddings(stored: DataFrame, batch: DataFrame, active: DataFrame, dimensions: int, most: int = 2000) -> DataFrame:
    """The embedding table after a batch; one stale, repeated or malformed vector rejects all of it."""
    if batch.limit(most + 1).count() > most:
        raise ValueError(f"a batch has at most {most} vectors")
    if batch.groupBy("chunk_id").count().filter("count > 1").limit(1).count():
        raise ValueError("a chunk id repeats")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if batch.filter((F.size("vector") != dimensions) | bad).limit(1).count():
        raise ValueError("a vector is malformed")
    if batch.join(active, ["chunk_id", "content_sha256"], "left_anti").limit(1).count():
        raise ValueError("a chunk is not active")
    return stored.join(batch.select("chunk_id"), "chunk_id", "left_anti").unionByName(batch)


def active_chunks(documents: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of approved documents' current versions."""
    key = ["source_type", "source_id", "content_sha256"]
    current = documents.filter("status = 'approved'").withColumnRenamed("current_sha256", "content_sha256")
    return chunks.join(versions.join(current, key).select(*key), key, "left_semi")


def chunk_counts(documents: DataFrame, versions: DataFrame, chunks: DataFrame, fields: list[str]) -> DataFrame:
    """Documents with their current version's number of chunks, 0 where there are none."""
    key = ["source_type", "source_id", "content_sha256"]
    current = documents.withColumnRenamed("current_sha256", "content_sha256").join(versions, key)
    return current.join(chunks.select(*key, "chunk_id"), key, "left").groupBy(*key, *fields).agg(F.count("chunk_id").alias("n_chunks"))


def title_page(works: DataFrame, query: str | None, title: str, year: str, key: str, limit: int, offset: int) -> DataFrame:
    """Title search: literal ASCII-folded substring; newest year first, then title, then id."""
    words = " ".join((query or "").split())
    if len(words) > 128:
        raise ValueError("query must have at most 128 characters")
    if words:
        works = works.filter(F.contains(ascii_lower(F.coalesce(F.col(title), F.lit(""))), F.lit(words.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))))
    return works.orderBy(F.desc_nulls_last(year), ascii_lower(F.col(title)), key).offset(offset).limit(limit)


def arxiv_page(works: DataFrame, query: str | None, limit: int, offset: int) -> DataFrame:
    """Listing of (arxiv_id, title, abstract, published_at): literal ASCII-folded substring of title or abstract; newest first, then id."""
    if not (1 <= limit <= 50 and 0 <= offset <= 10_000):
        raise ValueError("limit 1 to 50, offset 0 to 10,000")
    words = " ".join((query or "").split())
    if words:
        folded = words.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        holds = lambda c: F.contains(ascii_lower(F.coalesce(F.col(c), F.lit(""))), F.lit(folded))
        works = works.filter(holds("title") | holds("abstract"))
    return works.orderBy(F.desc("published_at"), "arxiv_id").offset(offset).limit(limit)


def newest_snapshots(snapshots: DataFrame, limit: int = 20) -> DataFrame:
    """The last imported snapshots, newest first; ties by id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit 1 to 100")
    return snapshots.orderBy(F.desc("imported_at"), "snapshot_id").limit(limit)


def year_range(works: DataFrame, year: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Inclusive range; a null year fails as soon as a bound is set."""
    if low is not None:
        works = works.filter(F.col(year) >= low)
    if high is not None:
        works = works.filter(F.col(year) <= high)
    return works


def compare_ordered(works: DataFrame, ids: list, key: str, fields: list[str]) -> tuple[list, DataFrame]:
    """(missing ids, rows in the order asked); 2 to 5 different ids."""
    if not 2 <= len(ids) <= 5 or len(set(ids)) != len(ids):
        raise ValueError("2 to 5 different ids")
    spark = works.sparkSession
    asked = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"{key} {dict(works.dtypes)[key]}, position int")
    rows = F.broadcast(asked).join(works.select(key, *fields, F.lit(1).alias("there")), key, "left").orderBy("position")
    missing = [r[key] for r in rows.filter("there IS NULL").select(key).collect()]
    return missing, rows.filter("there IS NOT NULL").select("position", key, *fields)


def observation(c: Column, most: int, name: str) -> list[Column]:
    """A text cut to ``most`` characters, and whether it was longer."""
    return [F.substring(c, 1, most).alias(name), (F.char_length(c) > most).alias(f"{name}_truncated")]


#: Entries that an observation lists at most.
LISTED = {"authors": 50, "categories": 30, "references": 50}


def listed(c: Column, kind: str) -> Column:
    """The entries of an array that an observation shows."""
    return F.slice(c, 1, LISTED[kind]).alias(kind)


def bounded_table(rows: Column, n_rows: int = 100, n_cells: int = 50, n_chars: int = 1000) -> Column:
    """A view of array<array<string>> with bounded rows, cells and characters."""
    return F.transform(F.slice(rows, 1, n_rows), lambda r: F.transform(F.slice(r, 1, n_cells), lambda c: F.substring(c, 1, n_chars)))


def table_truncated(rows: Column, n_rows: int = 100, n_cells: int = 50) -> Column:
    """Whether the bounded view leaves rows out, or cells of the rows it shows."""
    return (F.size(rows) > n_rows) | F.exists(F.slice(rows, 1, n_rows), lambda r: F.size(r) > n_cells)


def inverted_index(words: Column) -> Column:
    """A map word -> places, from 0, of an array of words; null if it is null. Made within the row, by sorting."""

    def listed(placed):
        n = F.size(placed)
        differs = lambda k: (k == 0) | (F.get(placed, k - 1)["word"] != F.get(placed, k)["word"])
        starts = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), differs)
        entry = lambda a, b: F.struct(F.get(placed, a)["word"].alias("word"), F.transform(F.slice(placed, a + 1, b - a), lambda x: x["at"]).alias("places"))
        # each run of a word ends where the next begins, the last one with the array
        runs = lambda at: F.zip_with(at, F.array_append(F.slice(at, 2, F.greatest(F.lit(0), F.size(at) - 1)), n), entry)
        return bound(starts, lambda at: F.when(F.size(at) > 0, F.map_from_entries(runs(at))))

    return bound(F.sort_array(F.transform(words, lambda w, k: F.struct(w.alias("word"), k.alias("at")))), listed)


def abstract_from_index(index: Column) -> Column:
    """struct(status, abstract) of a map word -> places.

    Empty or null: missing. A word over 2,000 or a text over 250,000 characters: oversized. A place
    below 0, from 50,000 on, or taken twice: invalid. Gaps vanish in the white space collapse.
    """
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    long_word = F.exists(F.map_keys(index), lambda w: F.char_length(w) > 2000)

    # pairs, text and status are each worked out once
    def told(pairs):
        places = F.transform(pairs, lambda p: p["at"])
        invalid = F.exists(places, lambda p: (p < 0) | (p >= 50_000)) | (F.size(F.array_distinct(places)) != F.size(places))

        def read(text):
            status = (
                F.when(index.isNull() | (F.cardinality(index) == 0), "missing").when(long_word, "oversized").when(invalid, "invalid").when(F.char_length(text) > 250_000, "oversized").otherwise("available")
            )
            return bound(status, lambda s: F.struct(s.alias("status"), F.when(s == "available", F.trim(F.regexp_replace(text, r"(?U)\s+", " "))).alias("abstract")))

        return bound(F.array_join(F.transform(F.sort_array(pairs), lambda p: p["word"]), " "), read)

    return bound(pairs, told)


def work_view(raw: DataFrame) -> DataFrame:
    """Works of landed source records: id tail, title or display name, named authors and their ids (null if malformed), venue."""
    return raw.select(
        F.substring_index("id", "/", -1).alias("work_id"),
        F.coalesce("title", "display_name").alias("title"),
        "doi",
        "publication_year",
        F.transform(F.filter("authorships", lambda a: a["author"]["display_name"].isNotNull()), lambda a: a["author"]["display_name"]).alias("authors"),
        F.transform(F.filter("authorships", lambda a: a["author"]["display_name"].isNotNull()), lambda a: author_id(a["author"]["id"])).alias("author_ids"),
        F.col("primary_location.source.display_name").alias("venue"),
        abstract_from_index(F.col("abstract_inverted_index")).alias("a"),
        "referenced_works",
    ).select("*", "a.status", "a.abstract").drop("a")


def citation_hop(works: DataFrame, seed: str, most: int = 10) -> DataFrame:
    """One hop from a seed: up to ``most`` works it cites and that cite it (id, direction)."""
    out = works.filter(F.col("work_id") == seed).select(F.explode("referenced_works").alias("r")).select(F.substring_index("r", "/", -1).alias("work_id"), F.lit("cites").alias("direction"))
    back = works.filter(F.exists("referenced_works", lambda r: F.substring_index(r, "/", -1) == seed)).select("work_id", F.lit("cited_by").alias("direction"))
    return out.orderBy("work_id").limit(most).unionByName(back.orderBy("work_id").limit(most))


def ledger_state(events: DataFrame) -> DataFrame:
    """Runs as their log has them: created running; the first finish that meets a running run counts."""
    final = F.min_by(F.struct("status", "at"), F.struct("at", "seq"))
    made = events.filter("status = 'running'").groupBy("run_id").agg(F.min("at").alias("created_at"))
    done = events.filter("status <> 'running'").groupBy("run_id").agg(final.alias("f"))
    return made.join(done, "run_id", "left").select("run_id", "created_at", F.coalesce("f.status", F.lit("running")).alias("status"), F.coalesce("f.at", "created_at").alias("updated_at"))


def lineage_audit(documents: DataFrame) -> DataFrame:
    """(state, n): a version is verified if all its five checks hold."""
    checks = ["text_hash_ok", "content_hash_ok", "license_ok", "chunks_ok", "pointer_ok"]
    ok = F.array_min(F.array(*[F.coalesce(F.col(c), F.lit(False)).cast("int") for c in checks])) == 1
    return documents.groupBy(F.when(ok, "verified").otherwise("mismatch").alias("state")).agg(F.count("*").alias("n"))


LINEAGE_FIELDS = ("text_sha256", "source_type", "source_id", "text_source_url", "license_id", "license_url", "license_evidence_url", "attribution", "chunker_version", "parser_version", "source_document_sha256", "parser_structure_sha256")
REVIEW_FIELDS = ("license_id", "license_url", "license_evidence_url", "reviewer", "attribution")


def ingest_gate(manifests: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): manifests without a problem whose paper is in the catalogue, and the rest.

    ``manifests`` has source_type, source_id and problem; ``works`` has source_type, source_id, title.
    """
    keys = ["source_type", "source_id"]
    fine = manifests.filter("problem IS NULL").drop("problem")
    accepted = fine.join(works.select(*keys, "title"), keys)
    unknown = fine.join(works.select(*keys), keys, "left_anti").withColumn("problem", F.lit("paper not in the catalogue"))
    return accepted, manifests.filter("problem IS NOT NULL").unionByName(unknown)


def content_key(versions: DataFrame) -> DataFrame:
    """Adds content_sha256 over the twelve lineage fields; a new parser or chunker is a new version."""
    from quillon.functions.text import content_sha256

    return versions.withColumn("content_sha256", content_sha256({c: F.col(c).cast("string") for c in LINEAGE_FIELDS}))


def carry_reviews(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The review time of each incoming document: kept if all review fields are as stored, else new."""
    keys = ["source_type", "source_id"]
    old = stored.select(*keys, F.struct(*REVIEW_FIELDS).alias("old"), F.col("reviewed_at").alias("old_at"))
    same = F.struct(*REVIEW_FIELDS).eqNullSafe(F.col("old"))
    return incoming.join(old, keys, "left").withColumn("reviewed_at", F.when(same, F.col("old_at")).otherwise(F.col("reviewed_at"))).drop("old", "old_at")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n) of the keys that occur more than once; a batch with any is refused."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def review_rows(pairs: DataFrame, fields: list[str], keys: tuple[str, ...] = ("query_id", "work_id")) -> DataFrame:
    """The rows of a review pack: keys and the fields a reviewer may see, grades left open.

    Raises if a key repeats: a pack has each pair once.
    """
    if repeated_keys(pairs, *keys).limit(1).count():
        raise ValueError("a pair repeats")
    return pairs.select(*keys, *fields, F.lit(None).cast("int").alias("grade"))


def section_path(c: Column, legacy: Column) -> Column:
    """A section path given as JSON array, JSON string or plain text; the older field, or null, without one."""
    listed = F.from_json(c, "array<string>")
    one = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>")
    return F.when(c.isNull(), F.when(legacy.isNotNull(), F.array(legacy))).when(c.rlike(r"^\s*\[.*\]\s*$") & listed.isNotNull(), listed).when(c.rlike(r'^\s*".*"\s*$') & one.isNotNull(), one).otherwise(F.array(c))


#: Fields of an evidence item that an evaluation may see.
EVIDENCE_FIELDS = ("source_type", "source_id", "chunk_id", "locator", "page_number", "element_type", "excerpt", "score", "content_sha256")


def allowed_fields(items: DataFrame, allowed: tuple[str, ...] = EVIDENCE_FIELDS) -> DataFrame:
    """The allowed fields that are there, in the order of the list; all others are left out."""
    return items.select(*[c for c in allowed if c in items.columns])


def usable_tools(wanted: Column, registered: Column) -> Column:
    """The tools a skill wants that are registered, each once, in the skill's order; null lists have none."""
    none = F.array().cast("array<string>")
    return F.array_intersect(F.coalesce(wanted, none), F.coalesce(registered, none))


def works_of_author(works: DataFrame, author: str, per_page: int = 25, page: int = 1) -> DataFrame:
    """A page of the works that list an author's id, by work id; an author listed twice counts once."""
    if not (1 <= per_page <= 25 and page >= 1):
        raise ValueError("1 to 25 works a page")
    return works.filter(F.array_contains("author_ids", author)).orderBy("work_id").offset((page - 1) * per_page).limit(per_page)
