"""The stored catalogue: documents, chunks, lexical index, vectors, hashes and grants as segmented tables (see ``sources.segments``).

Everything is an upsert or a delete by key, written as one segment and seen at once. Lexical rows and vectors are keyed by chunk; they carry
``doc_id``, so that the deletion of a document reaches every table. Postings are pages: a row holds, for one bucket of terms and one block of item numbers, each
term with the items that hold it and how often they do. BM25 answers from the segments: postings count where
their item's newest row carries the same number, and the number of items, their average length and the terms' counts are those of live items.
:func:`compact` rewrites what is live as base segments. A key must be written at most once in a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import FunctionType
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions.common import sized, within as few_rows
from ..session import written
from ..sources import segments
from . import cleaning, lexical
from .chunking import chunk
from .dense import check_vectors

#: The tables that hold rows of documents, with their keys. Postings hang on the rows of ``items``.
KEYS = {"documents": ("doc_id",), "chunks": ("chunk_id",), "items": ("item_id",), "vectors": ("item_id",), "hashes": ("tenant_id", "hash"), "grants": ("doc_id", "user_id")}
BUCKETS = 64
#: How postings name their item: a number, and the segment whose write gave it. Both stay when rows are rewritten.
NUMBER = ["origin", "no"]
#: Items of a block: ``no`` is ``block`` * ITEMS + ``at``.
ITEMS = 4096
PAGE = "bucket int, origin int, block long, terms array<string>, sizes array<int>, at array<short>, tfs array<int>"
#: Made-up terms, which no text has, in a bucket of their own: their lists hold the lengths of all items, and how many different terms these have.
LENGTHS, DIFFERENT = "", " "


def alive(df: DataFrame, deleted: bool = False) -> DataFrame:
    return df.withColumn("deleted", F.lit(deleted))


def numbered(chunks: DataFrame, origin: int) -> DataFrame:
    """``chunks`` with a number of their own; it holds once they are written."""
    return chunks.withColumn("origin", F.lit(origin)).withColumn("no", F.monotonically_increasing_id())


def bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def item_rows(chunks: DataFrame, post: DataFrame) -> DataFrame:
    """item_id, tenant_id, doc_id, dl, n_terms, origin, no of numbered chunks, from their postings; a text without terms is an item of length 0."""
    made_up = unpacked(post.where(F.col("bucket") == BUCKETS))
    figures = made_up.groupBy(*NUMBER).agg(*[F.max(F.when(F.col("term") == term, F.col("tf"))).alias(name) for term, name in ((LENGTHS, "dl"), (DIFFERENT, "n_terms"))])
    return chunks.select(F.col("chunk_id").alias("item_id"), "tenant_id", "doc_id", *NUMBER).join(figures.hint("merge"), NUMBER).select("item_id", "tenant_id", "doc_id", "dl", "n_terms", *NUMBER)


def posting_pages(items: DataFrame, text: str = "text") -> DataFrame:
    """The pages of numbered items, dealt by bucket: terms, how many items hold each (sizes), and these one after another: their place in the block (at) and how often
    the term occurs (tfs). A batch of items is turned over at once, so that postings are neither rows nor shuffled or sorted one by one; a block may have several pages in a bucket."""
    plain, c = F.coalesce(~F.rlike(F.col(text), F.lit(lexical.NOT_PLAIN)), F.lit(False)), F.col(text)
    rows = items.select(*NUMBER, F.when(plain, c).alias("text"), F.when(~plain, lexical.terms(c)).alias("ts")).mapInArrow(turner(), PAGE)
    return rows.repartition(BUCKETS, "bucket")


def page_arrays(terms: pa.Array, sizes: np.ndarray, at: np.ndarray, tfs: np.ndarray, first: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """Columns of pages: ``first`` are where their terms begin and end, ``starts`` where their items do."""
    lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), x)
    return [lists(first, terms), lists(first, pa.array(sizes.astype(np.int32))), lists(starts, pa.array(at.astype(np.int16))), lists(starts, pa.array(tfs.astype(np.int32)))]


def turner() -> Callable:
    """A step from items (origin, no, and the text if it is plain, or else its terms) to pages. (Steps are nested functions: tasks need not have this module.)"""
    arrays, cut = local(page_arrays), lexical.cutter()

    def turn(origin: np.ndarray, no: np.ndarray, lengths: np.ndarray, flat: pa.Array) -> pa.RecordBatch:
        n, encoded = len(no), flat.dictionary_encode()
        key, tf = np.unique(encoded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, row = key // n, key % n
        n_words = len(encoded.dictionary)
        words = pa.concat_arrays([encoded.dictionary.cast(pa.string()), pa.array([LENGTHS, DIFFERENT], pa.string())])
        buckets = np.array([crc32(w) % BUCKETS for w in encoded.dictionary.cast(pa.binary()).to_pylist()] + [BUCKETS] * 2)
        term = np.concatenate([term, np.repeat([n_words, n_words + 1], n)])
        tf = np.concatenate([tf, lengths, np.bincount(row, minlength=n)])
        row = np.concatenate([row, np.arange(n), np.arange(n)])
        blocks, of = np.unique(origin << 42 | no // ITEMS, return_inverse=True)
        page = buckets[term] * len(blocks) + of[row]
        order = np.argsort(page.astype(np.int32), kind="stable")
        page, term, row, tf = page[order], term[order], row[order], tf[order]
        new = np.concatenate([[True], page[1:] != page[:-1]])
        run = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]) | new)
        starts = np.flatnonzero(new)
        made = arrays(words.take(pa.array(term[run])), np.diff(np.append(run, len(term))), no[row] % ITEMS, tf, np.append(np.searchsorted(run, starts), len(run)), np.append(starts, len(term)))
        block = blocks[page[starts] % len(blocks)]
        keys = [pa.array((page[starts] // len(blocks)).astype(np.int32)), pa.array((block >> 42).astype(np.int32)), pa.array(block & (1 << 42) - 1)]
        return pa.RecordBatch.from_arrays([*keys, *made], ["bucket", "origin", "block", "terms", "sizes", "at", "tfs"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for plain, part in ((True, batch.filter(batch["text"].is_valid())), (False, batch.filter(batch["text"].is_null()))):
                if len(part):
                    lengths, flat = cut(part["text"]) if plain else (part["ts"].value_lengths().to_numpy().astype(np.int64), part["ts"].flatten())
                    yield turn(part["origin"].to_numpy().astype(np.int64), part["no"].to_numpy(), lengths, flat)

    return step


def kept() -> Callable:
    """A step from pages with ``live`` (the bits of their block's live items) to what is left of them."""
    arrays = local(page_arrays)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            sizes, at, tfs, live = (batch[c].flatten().to_numpy() for c in ("sizes", "at", "tfs", "live"))
            many = batch["at"].value_lengths().to_numpy()
            hold = live.reshape(n, ITEMS // 64)[np.repeat(np.arange(n), many), at >> 6] >> (at & 63) & 1 == 1
            before = np.append(0, np.cumsum(hold))
            left = np.diff(before[np.append(0, np.cumsum(sizes))])
            first = np.append(0, np.cumsum(left > 0))[np.append(0, np.cumsum(batch["terms"].value_lengths().to_numpy()))]
            made = arrays(batch["terms"].flatten().filter(pa.array(left > 0)), left[left > 0], at[hold], tfs[hold], first, before[np.append(0, np.cumsum(many))])
            out = pa.RecordBatch.from_arrays([batch["bucket"], batch["origin"], batch["block"], *made], ["bucket", "origin", "block", "terms", "sizes", "at", "tfs"])
            yield out.filter(pa.array(np.diff(first) > 0))

    return step


def picker(words: pa.Array) -> Callable:
    """A step from pages to (origin, block, t, sizes, at, tfs): the lists of ``words``, by their numbers there."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = lambda offsets, x: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x))
        for batch in batches:
            sizes, at, tfs = (batch[c].flatten().to_numpy() for c in ("sizes", "at", "tfs"))
            t = pc.index_in(batch["terms"].flatten(), value_set=words).fill_null(-1).to_numpy()
            hold = np.repeat(t >= 0, sizes)
            first = np.append(0, np.cumsum(t >= 0))[np.append(0, np.cumsum(batch["terms"].value_lengths().to_numpy()))]
            starts = np.append(0, np.cumsum(hold))[np.append(0, np.cumsum(batch["at"].value_lengths().to_numpy()))]
            made = [lists(first, t[t >= 0]), lists(first, sizes[t >= 0]), lists(starts, at[hold]), lists(starts, tfs[hold])]
            yield pa.RecordBatch.from_arrays([batch["origin"], batch["block"], *made], ["origin", "block", "t", "sizes", "at", "tfs"]).filter(pa.array(np.diff(first) > 0))

    return step


def unpacker() -> Callable:
    """A step from pages to a row (term, origin, no, tf) for each posting."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                page = batch.slice(i, 1)
                sizes, at = page["sizes"].flatten().to_numpy(), page["at"].flatten().to_numpy()
                term = page["terms"].flatten().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                origin, block = page["origin"][0].as_py(), page["block"][0].as_py()
                yield pa.RecordBatch.from_arrays([term, pa.array(np.full(len(at), origin, np.int32)), pa.array(block * ITEMS + at.astype(np.int64)), page["tfs"].flatten()], ["term", "origin", "no", "tf"])

    return step


def local(f: Callable) -> Callable:
    """A copy of a function that goes to tasks by value."""
    return FunctionType(f.__code__, {"pa": pa, "np": np}, f.__name__)


def unpacked(pages: DataFrame) -> DataFrame:
    """A row (term, origin, no, tf) for each posting of pages."""
    return pages.select("origin", "block", "terms", "sizes", "at", "tfs").mapInArrow(unpacker(), "term string, origin int, no long, tf int")


def posting_rows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(term, origin, no, tf) of items, numbered or not: a row for each posting."""
    return unpacked(posting_pages(items if "no" in items.columns else numbered(items, 0), text).where(F.col("bucket") < BUCKETS))


def place() -> list[Column]:
    """origin, block and at of an item's number."""
    return [F.col("origin"), F.floor(F.col("no") / ITEMS).alias("block"), (F.col("no") % ITEMS).cast("int").alias("at")]


def vector_rows(chunks: DataFrame, source: Column, metadata: dict[str, Column] | None = None) -> DataFrame:
    """item_id, doc_id, tenant_id, embedding and payload (a map of texts) of chunks with an embedding; ``metadata`` goes into the payload as metadata_<key>,
    null values are left out."""
    fields = {"documentId": F.col("doc_id"), "tenantId": F.col("tenant_id"), "text": F.col("text"), "source": source, "startIndex": F.col("start_index"), "endIndex": F.col("end_index"), "chunkIndex": F.col("chunk_index")}
    fields |= {f"metadata_{k}": c for k, c in (metadata or {}).items()}
    payload = F.map_filter(F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c.cast("string"))]), lambda _, v: v.isNotNull())
    return chunks.select(F.col("chunk_id").alias("item_id"), "doc_id", "tenant_id", F.col("embedding").cast("array<float>").alias("embedding"), payload.alias("payload"))


def write(spark: SparkSession, path: str, tables: dict, base: bool = False, number: int | None = None) -> int:
    """Commit rows of the tables (with ``deleted``; postings without) as one segment."""
    return segments.append(path, tables, spark, {"postings": "bucket"}, base, number)


def tombstones(dead: DataFrame, name: str, seen: Observation | None = None) -> DataFrame:
    """Rows that delete those of a table: of what is not a key, no more than document, tenant and the number of terms. ``seen`` counts them, and postings."""
    kept = [f.name for f in dead.schema if f.name in {*KEYS[name], "doc_id", "tenant_id", "n_terms"}]
    few = dead.select(*kept)
    if seen:
        few = few.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("n_terms" if "n_terms" in kept else F.lit(0)).alias("postings"))
    return alive(few.select(*[F.col(f.name) if f.name in kept else F.lit(None).cast(f.dataType).alias(f.name) for f in dead.schema]), True)


def live(spark: SparkSession, path: str, name: str, at: segments.State | None = None) -> DataFrame:
    """The rows of a table that hold, with their segment."""
    found = segments.rows(spark, path, name, at)
    if found is None:
        raise ValueError(f"{path}: nothing was ever written to {name}")
    return segments.newest(found, *KEYS[name])


def stored_pages(spark: SparkSession, path: str, at: segments.State) -> DataFrame:
    post = segments.rows(spark, path, "postings", at)
    if post is None:
        raise ValueError(f"{path}: nothing was ever written to postings")
    return post


def live_pages(spark: SparkSession, path: str, at: segments.State) -> DataFrame:
    """The stored pages without the items that are not live. Those of a block are 4,096 bits, broadcast where all blocks' are few, so that pages stay where they are."""
    post = stored_pages(spark, path, at)
    if len(at.segments["items"]) == 1:  # nothing can be outdated
        return post.drop("segment")
    words = live(spark, path, "items", at).select(*place()).groupBy("origin", "block", F.shiftright("at", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("w"))
    blocks = words.groupBy("origin", "block").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("m"))
    blocks = blocks.select("origin", "block", F.transform(F.sequence(F.lit(0), F.lit(ITEMS // 64 - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("live"))
    both = post.join(sized(written(blocks, "live")), ["origin", "block"])
    return both.select("bucket", "origin", "block", "terms", "sizes", "at", "tfs", "live").mapInArrow(kept(), PAGE)


def live_postings(spark: SparkSession, path: str, at: segments.State | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(origin, no, term, tf, tenant_id, dl): a row for each posting of live items, those that carry the number of their item's newest row; only of the terms of
    ``asked`` (term, bucket), if it is given."""
    at = at or segments.state(spark, path)
    post = stored_pages(spark, path, at).where(F.col("bucket") < BUCKETS)
    if asked is None:
        rows = unpacked(post)
    else:
        held = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        rows = unpacked(post.where(F.col("bucket").isin(held))).join(sized(asked.select("term")), "term", "left_semi")
    return rows.join(live(spark, path, "items", at).select(*NUMBER, "tenant_id", "dl").hint("merge"), NUMBER)


def bm25(queries: DataFrame, path: str, k: int = 10, k1: float = lexical.K1, b: float = lexical.B, by_tenant: bool = False, most_k: int = 100) -> DataFrame:
    """(query_id, rank, item_id, score) of ``queries`` (query_id, text[, tenant_id]) over the live items; of postings only the asked terms' buckets are read.

    Without tenants, and if the queries' terms are few, a task takes a block of items with their pages and gives each item's asked terms; these rows are
    written once and ranked as :func:`lexical.bm25_runs` does, so that postings are not rows. Otherwise they are.
    """
    spark = queries.sparkSession
    at = segments.state(spark, path)
    wanted = lexical.asked_terms(queries, by_tenant)
    if not by_tenant and few_rows(wanted)[1]:
        asked = wanted.toArrow().combine_chunks()
        words = asked["term"].unique()
        with segments.cleaned(spark):
            found = written(asked_items(spark, path, at, words), "terms")
        return lexical.ranked(found, asked, words, dict(wanted.dtypes)["query_id"], {"": (float(k1), float(b))}, min(k, most_k)).drop("strategy")
    asked = wanted.select("term").distinct().withColumn("bucket", bucket(F.col("term")))
    hits = live_postings(spark, path, at, asked)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # no more rows than ``asked``
    found = live(spark, path, "items", at)
    stats = found.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    hits = hits.select("term", *NUMBER, "tenant_id", "tf", "dl").join(lexical.within(asked)[0](df), "term").crossJoin(F.broadcast(stats))  # one row
    return lexical.scored_numbers(hits.join(sized(wanted), [*["tenant_id"] * by_tenant, "term"]), found, NUMBER, min(k, most_k), k1, b)


def asked_items(spark: SparkSession, path: str, at: segments.State, words: pa.Array) -> DataFrame:
    """(item_id, dl, terms, tfs) of live items, as :func:`lexical.counted_terms` gives them, from the lists of ``words``."""
    held = sorted({crc32(w) % BUCKETS for w in words.cast(pa.binary()).to_pylist()})
    pages = stored_pages(spark, path, at).where(F.col("bucket").isin(held)).select("origin", "block", "terms", "sizes", "at", "tfs")
    post = pages.mapInArrow(picker(words.cast(pa.string())), "origin int, block long, t array<int>, sizes array<int>, at array<short>, tfs array<int>")
    found = live(spark, path, "items", at).select(*place(), "item_id", "dl")

    def by_item(items: pa.Table, post: pa.Table) -> pa.Table:
        t, sizes, at, tfs = (post[c].combine_chunks().flatten().to_numpy() for c in ("t", "sizes", "at", "tfs"))
        n, places = len(items), np.full(ITEMS, -1, np.int16)
        places[items["at"].to_numpy()] = np.arange(n)
        row = places[at]
        order = np.argsort(row, kind="stable")[(row < 0).sum() :]  # what is not live comes first
        starts = pa.array(np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32))
        t, tfs = np.repeat(t, sizes)[order], tfs[order]
        arrays = [pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (t, tfs)]
        return pa.table({"item_id": items["item_id"], "dl": items["dl"], "terms": arrays[0], "tfs": arrays[1]})

    return found.groupBy("origin", "block").cogroup(post.groupBy("origin", "block")).applyInArrow(by_item, f"item_id {dict(found.dtypes)['item_id']}, dl int, terms array<int>, tfs array<int>")


def put_documents(spark: SparkSession, path: str, docs: DataFrame, within: Callable[[DataFrame], DataFrame] | None = None, embedded: Callable[[DataFrame], DataFrame] | None = None, more: dict[str, DataFrame] | None = None, size: int = 512, overlap: int = 128) -> int:
    """Upsert documents (tenant_id, doc_id, text, ...) with their chunks, lexical rows and, if ``embedded`` makes :func:`vector_rows` of
    chunks, vectors, as one segment; ``more``: rows of hashes and grants that come with them.

    Live rows that the new ones do not replace are deleted: among those of the same documents, or among those that ``within`` keeps (a whole
    tenant, say). ``docs`` is computed once; the other tables are made from what the segment holds by then.
    """
    at = segments.state(spark, path)
    new = {
        "documents": lambda done: docs,
        "chunks": lambda done: numbered(chunk(done["documents"].where("not deleted"), size, overlap), at.last + 1),
        "postings": lambda done: posting_pages(done["chunks"].where("not deleted")),
        "items": lambda done: item_rows(done["chunks"].where("not deleted"), done["postings"]),
        "vectors": lambda done: embedded(done["chunks"].where("not deleted").drop("deleted", *NUMBER)),
    }
    if not embedded:
        del new["vectors"]

    def outdated(name: str, done: dict[str, DataFrame]) -> DataFrame:
        old = live(spark, path, name, at).drop("segment")
        old = within(old) if within else old.join(sized(done["documents"].select("doc_id")), "doc_id", "left_semi")
        return tombstones(old.join(done[name].select(*KEYS[name]).hint("merge"), list(KEYS[name]), "left_anti"), name)

    tables: dict = {}
    for name, make in new.items():
        fresh = make if name == "postings" else lambda done, make=make: alive(make(done))
        replaces = name in KEYS and name in at.schemas and (within or name != "documents")  # documents that come again replace themselves
        tables[name] = (fresh, lambda done, name=name: outdated(name, done)) if replaces else fresh
    return write(spark, path, tables | {name: alive(df) for name, df in (more or {}).items()})


def delete_documents(path: str, requests: DataFrame) -> DataFrame:
    """Delete the requested documents (doc_id) from every table that was ever written, as one segment: (table, removed), counted while tombstones
    are written; for postings, those of the removed items."""
    spark = requests.sparkSession
    at = segments.state(spark, path)
    gone = sized(requests.select("doc_id").where("doc_id is not null").distinct())
    tables, counts = {}, {}
    for name in KEYS:
        if name in at.schemas:
            counts[name] = Observation(f"removed {name}")
            dead = live(spark, path, name, at).join(gone, "doc_id", "left_semi").drop("segment")
            tables[name] = tombstones(dead, name, counts[name])
    write(spark, path, tables)
    removed = [(name, int(o.get["n"])) for name, o in counts.items()]
    postings = int(counts["items"].get["postings"] or 0) if "items" in counts else 0
    return spark.createDataFrame([*removed, ("postings", postings)], "table string, removed long")


def compact(spark: SparkSession, path: str, drop: bool = True) -> int:
    """Rewrite the live rows of all tables as base segments of one number, and remove what they replace. Tables go one after another, so that no more than
    one is there twice; postings go before the items that say which of them are live."""
    at = segments.state(spark, path)
    number = at.last + 1
    if "postings" in at.schemas:
        pages = live_pages(spark, path, at)
        # Pages of one segment are dealt by bucket already.
        one = len(at.segments["postings"]) == 1
        write(spark, path, {"postings": pages if one else pages.repartition(BUCKETS, "bucket")}, True, number)
    for name in KEYS:
        if drop:
            segments.drop_old(spark, path)
        if name in at.schemas:
            rows = segments.settled(segments.rows(spark, path, name, at), *KEYS[name]).drop("segment")
            write(spark, path, {name: alive(rows)}, True, number)
    if drop:
        segments.drop_old(spark, path)
    return number


def put_vectors(spark: SparkSession, path: str, vectors: DataFrame, dimension: int) -> int:
    """Upsert :func:`vector_rows`; a vector of another dimension is an error, and then nothing is seen of the segment."""
    _, bad = check_vectors(vectors, dimension)
    wrong = bad.limit(1).collect()
    if wrong:
        raise ValueError(f"vector {wrong[0]['item_id']} does not have {dimension} numbers")
    return write(spark, path, {"vectors": alive(vectors)})
