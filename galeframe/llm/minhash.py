"""MinHash near-dedup: BagMinHash signatures, banding, exact multiset overlap.

A text is the multiset of its runs of five words (see textkit for words; a shorter text is one run
of all its words). Two texts are linked when their weighted Jaccard similarity
sum(min(count)) / sum(max(count)) is 0.8 or more; groups are the connected components of the links.

BagMinHash treats a run with count c as the weight interval [0, c) and throws one Poisson process
of points over it, each point aimed at one register of the signature; a register keeps its
earliest point. The interval is held as a hierarchy of dyadic pieces [0,1), [1,2), [2,4), [4,8) ...:
each piece has a process of its own, the same in all texts, so a text generates whole pieces that
lie below its count and halves only the last one, point by point, to see whether a point lies
below its count. Two texts' registers agree with probability equal to their weighted Jaccard
similarity.

Edge cases: a null text is linked with nothing; a text without any word is linked with equal texts
only; a null doc_id is never linked; repeated rows share a class; rows of different texts under
one doc_id count as one node. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import Store, connected_components, named, scratch, stored, text_slices
from galeframe.llm.textkit import U, mix, shingles, text_keys, word_hashes


@dataclass(frozen=True)
class MinHashConfig:
    """At similarity 0.8, 24 bands of 5 registers miss a pair with probability 8e-5."""

    width: int = 5
    bands: int = 24
    rows: int = 5
    threshold: float = 0.8


def _bags(owner: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, run) with counts, ordered by owner."""
    order = np.lexsort((sh, owner))
    o, s = owner[order], sh[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return o[at], s[at], np.diff(np.append(at, len(o)))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Open (0, 1) from 64 random bits."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_signatures(owner: np.ndarray, run: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers matrix of point names; texts without runs keep 0."""
    earliest = np.full(texts * registers, np.inf)
    name = np.zeros(texts * registers, U)
    level = 0
    live = np.arange(len(run))
    while len(live):
        low = 0 if level == 0 else 1 << (level - 1)
        high = 1 << level
        live = live[count[live] > low]
        o, piece, c = owner[live], mix(run[live] ^ mix(np.full(len(live), level + 1, U))), count[live]
        t, k = np.zeros(len(live)), 0
        while len(o):
            point = mix(piece + U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            t = t - np.log(_uniform(point)) / (high - low)
            aim = mix(point ^ U(0xA0761D6478BD642F))
            slot = o * registers + ((aim >> U(32)) * U(registers) >> U(32)).astype(np.int64)
            hit = t < earliest[slot]
            if high - low > 1:  # halve the last piece: the bits of a point's place, the first half first
                hit &= low + np.floor(_uniform(mix(point ^ U(0xE7037ED1A0B428DB))) * (high - low)) < c
            s, th = slot[hit], t[hit]
            np.minimum.at(earliest, s, th)
            won = earliest[s] == th
            name[s[won]] = aim[hit][won]
            k += 1
            last = earliest.reshape(texts, registers).max(axis=1)
            on = t < last[o]
            o, piece, c, t = o[on], piece[on], c[on], t[on]
        level += 1
    return name.reshape(texts, registers)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("runs", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _signed(cfg: MinHashConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = word_hashes(part.column("text"))
                n = part.num_rows
                owner, sh = shingles(found, cfg.width)
                counts = np.diff(found.first)
                raw1, raw2 = text_keys(part.column("text"))
                o, s, c = _bags(owner, sh)
                sig = bag_signatures(o, s, c, n, cfg.bands * cfg.rows)
                key = np.zeros((n, cfg.bands), U)
                for i in range(cfg.rows):
                    key = mix(key) + sig[:, i :: cfg.rows]
                key = mix(key + np.arange(1, cfg.bands + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15))
                # the words in order, so that texts that differ in case and punctuation only are copies
                place = np.arange(len(found.values)) - np.repeat(found.first[:-1], counts)
                turn = mix(found.hashes() ^ mix(place.astype(U)))
                sums = np.concatenate([[U(0)], np.cumsum(turn, dtype=U)])
                twin = np.concatenate([[U(0)], np.cumsum(mix(turn), dtype=U)])
                none = counts == 0
                k1 = np.where(none, mix(raw1), sums[found.first[1:]] - sums[found.first[:-1]])
                k2 = np.where(none, raw2, twin[found.first[1:]] - twin[found.first[:-1]])
                ends = np.concatenate([[0], np.cumsum(np.where(none, 0, cfg.bands))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[~none].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.bincount(owner, minlength=n)), lists], schema=_SIGNED)

    return run


def signatures(docs: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """doc_id, k1, k2 (128-bit key of the word sequence), runs (their number) and bands (one key a band; none without words)."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_signed(cfg), "doc_id long, k1 long, k2 long, runs long, bands array<long>")
    )


def _overlaps(cfg: MinHashConfig):
    def bag(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _bags(*shingles(word_hashes(texts), cfg.width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
        for batch in batches:
            for part in text_slices(batch, "text_a"):
                for piece in text_slices(part, "text_b"):
                    oa, ra, ca = bag(piece.column("text_a"))
                    ob, rb, cb = bag(piece.column("text_b"))
                    total = np.bincount(oa, ca, piece.num_rows) + np.bincount(ob, cb, piece.num_rows)
                    o, r, c = np.concatenate([oa, ob]), np.concatenate([ra, rb]), np.concatenate([ca, cb])
                    order = np.lexsort((r, o))
                    o, r, c = o[order], r[order], c[order]
                    same = np.flatnonzero((o[1:] == o[:-1]) & (r[1:] == r[:-1]))
                    both = np.bincount(o[same], np.minimum(c[same], c[same + 1]), piece.num_rows)
                    ratio = np.divide(both, total - both, out=np.zeros(piece.num_rows), where=total > 0)
                    yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(ratio)], schema=schema)

    return run


def bits_for(n: int) -> int:
    """Bits of a bitmap that holds n keys: sixteen a key, 4 KB to 32 MB. Beyond 16 million keys it lets ever more through, never too little."""
    return 1 << min(28, max(15, (16 * n).bit_length()))


def bitmap(places: DataFrame) -> DataFrame:
    """number, bits: the places of a one-column frame as bitmaps of 4 KB."""
    p = places.toDF("place")
    return p.groupBy(F.bitmap_bucket_number("place").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


def maybe_among(rows: DataFrame, keys: DataFrame, key: str, name: str, bits: int) -> DataFrame:
    """rows with name: false where key is surely not in the one column of keys, by a bitmap of hashes (bits_for) sent to the rows.

    It only spares a shuffle: an exact join follows everywhere.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    number, held = f"{name}_number", f"{name}_bits"
    maps = bitmap(keys.select(place(keys.columns[0]))).withColumnsRenamed({"number": number, "bits": held})
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(key)) == F.col(number), "left")
    return met.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(number, held)


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents named by the stored one-column frame ids, each different text of an id once; few other texts are shuffled."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    some = maybe_among(rows, ids, "doc_id", "maybe", bits_for(ids.count())).where("maybe").select("doc_id", "text")
    named = some.join(ids.toDF("doc_id"), "doc_id", "left_semi")
    return named.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("doc_id", "text")


def overlaps(pairs: DataFrame, texts: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """(a, b, similarity) of all pairs: the exact weighted Jaccard similarity of their multisets."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_overlaps(cfg), "a long, b long, similarity double")


def _comparable(a: str, b: str, cfg: MinHashConfig) -> Column:
    """Whether multisets of these sizes could reach the threshold: similarity is at most the smaller size by the larger."""
    return F.least(a, b) >= F.greatest(a, b) * (cfg.threshold - 1e-9)


def _elements(cfg: MinHashConfig):
    """doc_id and the bag of each text as a set: a run that occurs c times gives c elements, named by the run and its turn."""
    schema = pa.schema([("rep", pa.int64()), ("bag", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                o, s, c = _bags(*shingles(word_hashes(part.column("text")), cfg.width))
                turn = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                sets = mix(np.repeat(s, c) + mix(turn.astype(U)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(o, c, part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))], schema=schema)

    return run


def shared_counts(left: np.ndarray, owner: np.ndarray, element: np.ndarray, texts: int) -> np.ndarray:
    """len(left) x texts matrix: how many elements two sets share. owner and element list the sets' elements, left the rows asked for.

    Elements of few sets add their pairs one by one; the others are multiplied as columns of 0 and 1, some thousand at a time.
    """
    row = np.full(texts, -1)
    row[left] = np.arange(len(left))
    out = np.zeros((len(left), texts), np.int64)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(element)))
    few = np.repeat((many >= 2) & (many <= 8), many)
    o, e = owner[few], element[few]
    for k in range(1, 8):
        same = np.flatnonzero(e[k:] == e[:-k])
        for x, y in ((o[same], o[same + k]), (o[same + k], o[same])):
            on = row[x] >= 0
            out += np.bincount(row[x[on]] * texts + y[on], minlength=out.size).reshape(out.shape) if on.any() else 0
    column = np.repeat(np.cumsum(many > 8) - 1, many)
    often = np.repeat(many > 8, many)
    o, column = owner[often], column[often]
    wide = max(256, (1 << 22) // max(1, texts))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, [at, at + wide])
        held = np.zeros((texts, wide), np.float32)  # sums below 2 ** 24 are exact
        held[o[lo:hi], column[lo:hi] - at] = 1
        out += np.rint(held[left] @ held.T).astype(np.int64)
    return out


def _tile_links(cfg: MinHashConfig):
    """Links that join the components of a tile's members: at most one less than there are components."""

    def linked(rep: np.ndarray, component: np.ndarray, other: np.ndarray, first: np.ndarray, bag: np.ndarray) -> Iterator[tuple[int, int]]:
        size = np.diff(first)
        left = np.flatnonzero(other)
        both = shared_counts(left, np.repeat(np.arange(len(rep)), size), bag, len(rep))
        total = size[left][:, None] + size[None, :] - both
        near = (both >= cfg.threshold * total) & (component[left][:, None] != component[None, :])
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        for i in np.flatnonzero(near.any(axis=1)):
            to = np.flatnonzero(near[i])
            to = to[np.unique(component[to], return_index=True)[1]]
            for j in to.tolist():
                a, b = root(int(component[left[i]])), root(int(component[j]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    yield int(rep[left[i]]), int(rep[j])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket").combine_chunks()
        bucket, rep, component = (table[c].to_numpy() for c in ("bucket", "rep", "component"))
        other = table["other"].to_numpy(zero_copy_only=False)
        bags = table["bag"].combine_chunks()
        bags = bags.chunk(0) if isinstance(bags, pa.ChunkedArray) else bags
        ends, bag = bags.offsets.to_numpy(), bags.values.to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        found = [x for lo, hi in zip(cut[:-1], cut[1:], strict=True) for x in linked(rep[lo:hi], component[lo:hi], other[lo:hi], ends[lo : hi + 1] - ends[lo], bag[ends[lo] : ends[hi]])]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return run


def bucket_links(rest: DataFrame, texts: DataFrame, store: Store, cfg: MinHashConfig, most: int = 512, most_runs: int = 1 << 20) -> DataFrame:
    """(a, b): links that join the components of each bucket as all links between its members would.

    rest: bucket, rep, component, runs. A bucket's largest component is its main one; what lies in it
    is joined already, so only the others are compared, with each other and with the main one. Both
    are cut into blocks of about most members and most_runs runs by a hash, and a tile holds a block
    of others with one more block; small buckets are one tile, several of them a group. A tile
    returns links between different components only, fewer than it has members, and no pair of
    members is ever a row.
    """
    held = rest.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("runs").alias("r"))
    held = held.groupBy("bucket").agg(F.max(F.struct("n", "r", "component")).alias("m"), F.sum("n").alias("n"), F.sum("r").alias("r"))
    blocks = lambda n, r: F.greatest(F.lit(1), F.ceil(n / most), F.ceil(r / most_runs)).cast("int")
    shape = held.select("bucket", F.col("m.component").alias("main"), blocks(F.col("m.n"), F.col("m.r")).alias("mains"), blocks(F.col("n") - F.col("m.n"), F.col("r") - F.col("m.r")).alias("others"), "r", ((F.col("n") <= most) & (F.col("r") <= most_runs)).alias("small"))
    shape = store(shape)
    packs = max(1, -(-(shape.where("small").agg(F.sum("r")).first()[0] or 0) // most_runs))
    each = rest.select("bucket", "rep", "component").join(shape.drop("r"), "bucket").withColumn("other", F.col("component") != F.col("main"))
    block = F.pmod(F.xxhash64("rep"), F.when(F.col("other"), F.col("others")).otherwise(F.col("mains"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    of_other = F.concat(F.transform(upto("others"), lambda t: pair(F.least("block", t), F.col("mains") + F.greatest("block", t))), F.transform(upto("mains"), lambda t: pair(F.col("block"), t)))
    tiles = F.when(F.col("small"), F.array(pair(F.lit(0), F.lit(0)))).when(F.col("other"), of_other).otherwise(F.transform(upto("others"), lambda t: pair(t, F.col("block"))))
    each = each.withColumn("block", block).withColumn("tile", F.explode(tiles))
    part = F.when(F.col("small"), F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.col("bucket"))
    each = each.select("bucket", "rep", "component", "other", "small", part.alias("part"), "tile.i", "tile.j")
    own = texts.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    bags = own.mapInArrow(_elements(cfg), "rep long, bag array<long>")
    return each.join(bags, "rep").groupBy("small", "part", "i", "j").applyInArrow(_tile_links(cfg), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (smallest doc_id of its group), kept.

    Copies (equal word sequences) collapse before banding. In each bucket every member is compared
    with the bucket's hub, the member that meets most others over all its bands, so a group of n
    near copies costs n comparisons and not n * n / 2. Members of one bucket that these links leave
    in different groups are compared in tiles (bucket_links), all of them. Different texts under one
    doc_id are one node: it has the links of each of them.
    """
    with scratch(docs.sparkSession) as store:
        signed = store(signatures(docs, cfg))
        reps = store(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("runs").alias("runs"), F.first("bands").alias("bands")))
        links = _links(reps, docs, store, cfg)
        groups = connected_components(links).select(F.col("node").alias("rep"), "component")
        classes = reps.select("k1", "k2", "rep").join(groups, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("class_id"))
        found = signed.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"]).select("doc_id", "class_id")
        alone = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NULL OR text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
        return stored(found.unionByName(alone).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept")))


def _links(reps: DataFrame, docs: DataFrame, keep: Store, cfg: MinHashConfig) -> DataFrame:
    """(a, b) between reps: links whose connected components are those of all links of a common bucket."""
    with scratch(docs.sparkSession) as store:
        members = reps.select("rep", "runs", F.explode("bands").alias("bucket"))
        size = store(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
        members = maybe_among(members, size.select("bucket"), "bucket", "maybe", bits_for(size.count())).where("maybe").drop("maybe")
        members = store(members.join(size, "bucket"))
        hubs = members.groupBy("rep").agg(F.sum("size").alias("met"))
        members = store(members.select("bucket", "rep", "runs").join(hubs, "rep"))
        lead = members.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("rep")).alias("neg"), "runs")).alias("top")).select("bucket", (-F.col("top.neg")).alias("hub"), F.col("top.runs").alias("hub_runs"))
        members = members.select("bucket", "rep", "runs").join(lead, "bucket")
        members = store(members.withColumns({"a": F.least("rep", "hub"), "b": F.greatest("rep", "hub"), "near_size": _comparable("runs", "hub_runs", cfg)}))
        pairs = members.where("a < b AND near_size").select("a", "b").distinct()
        ids = store(members.select(F.col("rep").alias("doc_id")).distinct())
        texts = store(texts_of(ids, docs))
        links = store(overlaps(pairs, texts, cfg).where(F.col("similarity") >= cfg.threshold).select("a", "b").distinct())
        groups = connected_components(links).withColumnRenamed("node", "rep")
        placed = store(members.join(groups, "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"), "runs"))
        split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
        rest = store(placed.join(split, "bucket"))
        return keep(links.unionByName(bucket_links(rest, texts, store, cfg)))


def drop_near_duplicates(docs: DataFrame, cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """docs with one document of each group; rows with a null doc_id all stay.

    Of several rows with one doc_id the one with the smallest text stays (a null last), and of equal texts the row
    whose other columns come first as JSON. Only documents that go or whose id repeats, and few
    others, are shuffled; the rest pass where they lie.
    """
    columns = docs.columns
    row = F.struct(*[named(c) for c in columns])
    held = docs.select(F.col("doc_id").cast("long").alias("id"), row.alias("row"))
    classes = near_duplicates(docs, cfg).where("doc_id IS NOT NULL")
    odd = classes.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"), F.bool_or("kept").alias("keep")).where("n > 1 OR NOT keep")
    odd = stored(odd.select("id", "keep"))
    marked = maybe_among(held, odd.select("id"), "id", "maybe", bits_for(odd.count()))
    clear = marked.where("id IS NULL OR NOT maybe").select("row")
    doubtful = marked.where("id IS NOT NULL AND maybe").join(odd, "id", "left").where(F.coalesce("keep", F.lit(True)))
    one = doubtful.groupBy("id").agg(F.min_by("row", F.struct(F.col("row.text").isNull().alias("none"), F.col("row.text").alias("text"), F.to_json("row").alias("json"))).alias("row")).select("row")
    return clear.unionByName(one).select("row.*")
