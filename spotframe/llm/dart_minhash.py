"""Near-duplicate classes by DartMinHash signatures.

A document is the weighted set of its shingles of ``SHINGLE`` lower-cased words (split at
white space), weighted by how often each occurs; a text of fewer words is one shingle, a
text without words is empty.  Every unit of weight of every element is a region on which
hashed darts fall along a rank axis as a Poisson process of rate one.  Only darts with
rank up to t / weight are thrown, with t = k ln k + 2k, so a signature costs about as much
as reading the text; each dart hits one of ``COORDINATES`` coordinates and the earliest
dart of each coordinate is kept.  Where a coordinate stays empty the rank limit doubles.
Two signatures agree in a coordinate with the weighted Jaccard of the documents as
probability.

Signatures are joined on ``BANDS`` bands of ``ROWS`` coordinates.  Equal texts share one
representative.  A link is a pair of representatives that share a band and whose weighted
Jaccard, computed exactly on the whole texts, is at least ``SIMILARITY``; classes are the
connected components of the links.  Only pairs of still different classes are compared:

1. every bucket's first member with all others (copies of one text: one comparison each);
2. the members with most links so far, ``PIVOTS`` of them, with all others;
3. what is left, in blocks of ``BLOCK`` members: a task compares two blocks of a bucket and
   gives back links only.  Each pair is compared in the first band it shares, and not at
   all once the links found on the way have joined its classes.

Before texts are compared, pairs are passed over whose signatures agree in fewer coordinates
than 4.2 standard deviations below the threshold allow.  A pair at the threshold
shares no band with a probability under 3e-5 and is passed over with one under 2e-5.  There
is no bound on the size of a bucket or on a member's partners.

A null text counts as empty, and all empty texts are one class.  A text is known by the
smallest doc_id that has it: rows that repeat a doc_id with another text are judged by
their own text, and two texts known by one doc_id are one class, with all links of either.
A row without doc_id has no class (null) and links nothing.  A table without rows gives no
rows.  Texts are read whole, however long, a few million characters at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotframe.llm.common import fresh, text_of
from spotframe.llm.tokenize import by_chars
from spotframe.session import stage, unstage

SHINGLE = 5
COORDINATES, BANDS, ROWS = 160, 20, 4
SIMILARITY = 0.8
PIVOTS = 8
BLOCK = 512
_PHI = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weighted_units(texts: list[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, unit) of a batch, sorted by both: the n-th occurrence of a shingle in a
    document is a unit of its own, so sets of units have the weighted Jaccard."""
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    if not counts.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    codes, names = pd.factorize(np.array([w for ws in words for w in ws], dtype=object))
    hashed = pd.util.hash_array(names, categorize=False)[codes]
    ends = np.cumsum(counts)
    # a shingle of fewer words ends where its document does: later words count as nothing
    width = np.minimum(counts, shingle)
    n = np.where(counts > 0, counts - width + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends - counts, n)
    left = np.repeat(width, n)
    padded = np.append(hashed, np.zeros(shingle, np.uint64))
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(shingle):
            value = mix(value * _PHI + np.where(k < left, padded[at + k], np.uint64(k)) + np.uint64(1))
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        first = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))
        run = np.flatnonzero(first)
        occurrence = np.arange(len(value)) - np.repeat(run, np.diff(np.append(run, len(value))))
        unit = mix(value + _PHI * occurrence.astype(np.uint64))
    order = np.lexsort((unit, doc))
    return doc[order], unit[order]


def dart_signatures(doc: np.ndarray, unit: np.ndarray, documents: int,
                    coordinates: int = COORDINATES) -> np.ndarray:
    """(documents x coordinates) identities of the earliest darts; rows of documents without
    units are zero."""
    k = coordinates
    out = np.zeros((documents, k), np.uint64)
    weight = np.bincount(doc, minlength=documents)
    limit = (k * math.log(k) + 2 * k) / np.maximum(weight, 1)
    todo = weight > 0
    scale = 2.0 ** -53
    with np.errstate(over="ignore"):
        while todo.any():
            some = todo[doc]
            d, u = doc[some], unit[some]
            rank = np.zeros(len(d))
            hit_cell, hit_rank, hit_dart = [], [], []
            step = 0
            while len(d):
                step += 1
                dart = mix(u + _PHI * np.uint64(step))
                uniform = ((mix(dart ^ _PHI) >> np.uint64(11)).astype(np.float64) + 0.5) * scale
                rank = rank - np.log(uniform)
                near = rank <= limit[d]
                d, u, rank, dart = d[near], u[near], rank[near], dart[near]
                hit_cell.append(d * k + (mix(dart + _PHI) % np.uint64(k)).astype(np.int64))
                hit_rank.append(rank)
                hit_dart.append(dart)
            cell, rank, dart = map(np.concatenate, (hit_cell, hit_rank, hit_dart))
            order = np.lexsort((rank, cell))
            cell, dart = cell[order], dart[order]
            first = np.append(True, cell[1:] != cell[:-1])[:len(cell)]
            cell, dart = cell[first], dart[first]
            filled = np.bincount(cell // k, minlength=documents) == k
            full = filled[cell // k]
            out.reshape(-1)[cell[full]] = dart[full]
            todo &= ~filled
            limit = np.where(todo, 2 * limit, limit)
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, over the first bands x rows coordinates; the band's number is
    part of it."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(1, bands + 1).astype(np.uint64)), (len(signatures), bands)).copy()
        for r in range(rows):
            key = mix(key * _PHI + signatures[:, r:rows * bands:rows])
    return key.view(np.int64)


def signature_table(docs: DataFrame, shingle: int = SHINGLE, coordinates: int = COORDINATES,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, digest of the text, bands (keys) and marks (low byte of every coordinate); both
    empty for texts without words."""
    def lists(values: np.ndarray, has: np.ndarray) -> pa.Array:
        ends = np.append(0, np.cumsum(np.where(has, values.shape[1], 0)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[has].reshape(-1)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in by_chars(texts):
                doc, unit = weighted_units(texts[a:b], shingle)
                signs = dart_signatures(doc, unit, b - a, coordinates)
                has = np.bincount(doc, minlength=b - a) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("digest").slice(a, b - a),
                     lists(band_keys(signs, bands, rows), has), lists(signs.astype(np.uint8).view(np.int8), has)],
                    names=["doc_id", "digest", "bands", "marks"])

    text = text_of()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"),
                         text.alias("text"))
    return source.mapInArrow(sign, "doc_id long, digest binary, bands array<long>, marks array<tinyint>")


def unit_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """digest and the sorted units of its text (binary, unsigned 64-bit), of ``docs(digest, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in by_chars(texts):
                doc, unit = weighted_units(texts[a:b], shingle)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                body = [unit[cuts[i]:cuts[i + 1]].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(a, b - a), pa.array(body, pa.binary())],
                                                 names=["digest", "units"])
    return docs.select("digest", "text").mapInArrow(run, "digest binary, units binary")


def weighted_jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _verified(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among ``pairs(a, b, text_a, text_b)``, the texts by their digests."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [weighted_jaccard(x, y) >= similarity for x, y in zip(f["units_a"], f["units_b"])]
            yield f.loc[keep, ["a", "b"]]
    left = units.select(F.col("digest").alias("text_a"), F.col("units").alias("units_a"))
    right = units.select(F.col("digest").alias("text_b"), F.col("units").alias("units_b"))
    # the pivot's side last: it alone can be hot, and a skewed sort-merge join is split
    met = pairs.join(right, "text_b").join(left, "text_a").select("a", "b", "units_a", "units_b")
    return met.mapInPandas(run, "a long, b long")


def _to_roots(hook: DataFrame) -> DataFrame:
    """(node, up) with every pointer followed to its end, doubling the reach each time."""
    while True:
        further = hook.select(F.col("node").alias("up"), F.col("up").alias("beyond"))
        new = stage(hook.join(further, "up", "left").select(
            "node", F.coalesce("beyond", "up").alias("up"), F.col("beyond").isNotNull().alias("moved")))
        unstage(hook)
        moved, hook = not new.filter("moved").isEmpty(), new.select("node", "up")
        hook._stage_path = new._stage_path
        if not moved:
            return hook


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected edge list (a, b): every node is
    hooked to its smallest neighbour below it, the trees are contracted, and what is left of
    the edges joins the contracted nodes, until no edge is left."""
    between = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    left = stage(between(edges))
    labels = stage(left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
                   .withColumn("component", F.col("node")))
    while not left.isEmpty():
        roots = _to_roots(stage(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))))
        ends = {c: roots.select(F.col("node").alias(c), F.col("up").alias(f"root_{c}")) for c in ("a", "b", "component")}
        new = stage(labels.join(ends["component"], "component", "left").select(
            "node", F.coalesce("root_component", "component").alias("component")))
        rest = left.join(ends["a"], "a", "left").join(ends["b"], "b", "left").select(
            F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        rest = stage(between(rest))
        for done in (labels, left, roots):
            unstage(done)
        labels, left = new, rest
    return labels


def least_agreement(similarity: float, coordinates: int) -> int:
    """Coordinates in which a pair at the threshold agrees but for 4.2 standard deviations."""
    return max(0, math.ceil(coordinates * similarity - 4.2 * math.sqrt(coordinates * similarity * (1 - similarity))))


def _alike(a: Column, b: Column, need: int) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) >= need


def _open_rows(rows: DataFrame) -> DataFrame:
    """The rows of buckets whose members are still in more than one class."""
    mixed = (rows.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
             .filter("low < high").select("bucket"))
    return rows.join(mixed, "bucket")


def _block_links(rows: DataFrame, units: DataFrame, similarity: float, need: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different classes.  Signatures
    travel first; the units of a member only to the blocks where one may be alike."""
    def candidates(f: pd.DataFrame, key: tuple, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        marks, keys = np.stack(f["marks"]), np.stack(f["keys"])
        part, band = f["block"].to_numpy(), int(f["band"].iloc[0])
        first = np.flatnonzero(part == key[1])
        for n, i in enumerate(first):
            others = first[n + 1:] if key[1] == key[2] else np.flatnonzero(part == key[2])
            others = others[(group[others] != group[i]) & ((marks[others] == marks[i]).sum(1) >= need)]
            yield i, others[~(keys[others, :band] == keys[i, :band]).any(1)]

    def alike(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        some = np.zeros(len(f), bool)
        for i, others in candidates(f, key, f["class"].to_numpy()):
            some[others] = True
            some[i] |= len(others) > 0
        return f.loc[some]

    def compare(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rep, group, found = f["rep"].to_numpy(), f["class"].to_numpy().copy(), []
        for i, others in candidates(f, key, group):
            for j in others:
                if group[j] != group[i] and weighted_jaccard(f["units"].iat[i], f["units"].iat[j]) >= similarity:
                    found.append((rep[i], rep[j]))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    blocks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = dealt.select("bucket", "band", "rep", "digest", "class", "marks", "keys", "block",
                         F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("with")
    left = stage(dealt.groupBy("bucket", "low", "high").applyInPandas(alike, dealt.schema))
    return left.join(units, "digest").groupBy("bucket", "low", "high").applyInPandas(compare, "a long, b long")


def _text_classes(docs: DataFrame, similarity: float, shingle: int, coordinates: int, bands: int,
                  rows_per_band: int) -> DataFrame:
    """doc_id, digest, class_id, representative of every row of ``docs(doc_id, text)``."""
    need = least_agreement(similarity, coordinates)
    signed = stage(signature_table(docs, shingle, coordinates, bands, rows_per_band))
    texts = signed.filter("doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    texts = stage(texts)
    # a bucket's members are texts, known by their digests; classes join the doc_ids they go by
    narrow = texts.select("rep", "digest", F.posexplode("bands").alias("band", "bucket"))
    shared = narrow.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    marks = texts.select("digest", "marks", F.transform("bands", lambda k: F.hash(k)).alias("keys"))
    rows = stage(narrow.join(shared, "bucket").join(marks, "digest").withColumn("class", F.col("rep"))
                 .withColumn("degree", F.lit(0).cast("long")))
    wanted = rows.select(F.col("rep").alias("doc_id"), "digest").distinct()
    source = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of(), 256)).alias("digest"),
                          text_of().alias("text")).join(wanted, ["doc_id", "digest"], "left_semi"))
    units = stage(unit_table(source.dropDuplicates(["doc_id", "digest"])))
    links = labels = None
    for pivots in (1, PIVOTS, None):
        if pivots is None:
            found = _block_links(rows, units, similarity, need)
        else:
            best = Window.partitionBy("bucket").orderBy(F.desc("degree"), F.xxhash64("rep"), "rep", "digest")
            chosen = (rows.select("bucket", "rep", "digest", "class", "marks", "degree")
                      .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= pivots))
            chosen = stage(chosen.select(F.col("bucket").alias("at"), F.col("rep").alias("pivot"), F.col("digest").alias("text_a"),
                                         F.col("class").alias("pivot_class"), F.col("marks").alias("pivot_marks")))
            pairs = rows.join(chosen, (F.col("bucket") == F.col("at")) & (F.col("class") != F.col("pivot_class"))
                              & _alike(F.col("marks"), F.col("pivot_marks"), need))
            pairs = pairs.select(F.col("pivot").alias("a"), F.col("rep").alias("b"), "text_a", F.col("digest").alias("text_b")).distinct()
            found = _verified(pairs, units, similarity)
        found = stage(found)
        links = found if links is None else stage(links.union(found))
        if not found.isEmpty():
            labels = components(links)
        if pivots is None:
            break
        if labels is not None:
            ends = links.select(F.col("a").alias("rep")).union(links.select("b"))
            degree = ends.groupBy("rep").agg(F.count("*").alias("degree"))
            state = labels.select(F.col("node").alias("rep"), F.col("component").alias("class")).join(degree, "rep")
            rest = rows.drop("class", "degree").join(state, "rep", "left").withColumns({
                "class": F.coalesce("class", "rep"), "degree": F.coalesce("degree", F.lit(0).cast("long"))})
        else:
            rest = rows
        # a pivot has met everyone in its bucket
        met = chosen.select(F.col("at").alias("bucket"), F.col("text_a").alias("digest"))
        before, rows = rows, stage(_open_rows(rest.join(met, ["bucket", "digest"], "left_anti")))
        unstage(before)
        unstage(chosen)
        if rows.isEmpty():
            break
    members = signed.select("doc_id", "digest").join(texts.select("digest", "rep"), "digest", "left")
    members = members.withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.col("rep")))
    if labels is None:
        return members.select("doc_id", "digest", F.col("rep").alias("class_id"), F.col("rep").alias("representative"))
    named = labels.select(F.col("node").alias("rep"), "component")
    return members.join(named, "rep", "left").select(
        "doc_id", "digest", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("representative"))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE,
                           coordinates: int = COORDINATES, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, class_id (smallest doc_id of the
    class), representative (smallest doc_id with the same text)."""
    return _text_classes(docs, similarity, shingle, coordinates, bands, rows_per_band).drop("digest")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of every class, the one of its smallest doc_id (of that id's texts
    the one with the smallest digest), all columns as they were; rows without doc_id stay."""
    columns = docs.columns
    classes = _text_classes(docs.select("doc_id", "text"), similarity, SHINGLE, COORDINATES, BANDS, ROWS)
    own_id, own_text = fresh(columns, "own_id"), fresh(columns, "own_text")
    stays = (classes.filter("doc_id = class_id").groupBy(F.col("doc_id").alias(own_id))
             .agg(F.min("digest").alias(own_text)))
    rows = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_text: F.unhex(F.sha2(text_of(), 256))})
    kept = rows.join(stays, [own_id, own_text], "left_semi").dropDuplicates([own_id, own_text]).select(*columns)
    return kept.unionByName(docs.filter("doc_id IS NULL"))
