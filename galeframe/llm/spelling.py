"""Spelling variants: words one edit apart, by bands of letter-parity masks.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. An inserted
or deleted letter flips one bit, a replaced one at most two. Letters are dealt to three bands by
turns, so of two near words of one length at least one band is equal, and of two near words whose
lengths differ by one at least two bands are. Words meet in buckets of equal length and one equal
band, or of lengths L and L + 1 and two equal bands; there whole masks are compared first, and what
differs in few enough bits is verified letter by letter. A pair is counted in the first bucket that
shows it only. Buckets are cut into blocks of bounded size and compared in tiles of two blocks; a
tile returns one row for each word with a near one, never its pairs. Buckets with no one to meet are
left out before the words travel.

A word's form is its most frequent near word if that is at least twice as frequent as itself, and
its root is where the forms lead. Counts double with each step, so a chain is no longer than the
logarithm of the largest count, and roots are found in a few rounds of joining the table with itself.

Edge cases: null texts have no words; a null doc_id counts as an empty one in the hash; texts of any
length are read whole, with at most _HELD different words of a task's rows at once in memory;
repeated rows count again; no words give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import Store, scratch, stored

# What a word is made of, and letters of Latin scripts by how often they occur, about.
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LETTERS = "etaoinshrdlucmfpgwybvkxqjz" + "".join(map(chr, range(0xC0, 0x100)))
_EVERY = 97

_LONG = 1 << 20  # characters of a text whose words are listed at once
_HELD = 1 << 17
_BLOCK = 4096  # words of a block
_BLOCK_CHARS = 1 << 18  # and characters, about
_PAIRS = 1 << 18  # pairs of masks compared at once
_KEY = ["kind", "band", "v1", "v2", "length"]


def _letter_numbers() -> np.ndarray:
    number = np.arange(0x110000, dtype=np.int32) % len(_LETTERS)  # other letters share bits, which only lets more pairs through to be verified
    number[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))
    return number


def altered(doc_id: str, word: str) -> str:
    """word, or word without one letter, as a hash of doc_id and word has it."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % _EVERY:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def emptied() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                doc_id, text = doc_id.as_py() or "", text.as_py() or ""
                runs = Counter(_RUN.findall(text)) if len(text) <= _LONG else Counter(m[0] for m in _RUN.finditer(text))
                for run_, n in runs.items():
                    if len(run_) >= least:
                        word = altered(doc_id, run_.encode().lower().decode())  # bytes.lower() knows A-Z only
                        if len(word) >= least:
                            held[word] += n
                if len(held) > _HELD:
                    yield emptied()
        yield emptied()
        pa.default_memory_pool().release_unused()  # an idle worker keeps what it holds

    return run


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): the words of all texts, with one letter taken out of some by hash, of min_length code points and min_count occurrences at least."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = rows.mapInArrow(_counted(min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = _letter_numbers()
    for batch in batches:
        words = batch.column("word").to_pylist()
        if not words:
            continue
        size = np.array([len(w) for w in words], np.int64)
        letter = number[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        first = np.cumsum(size) - size
        bit = np.left_shift(np.int64(1), letter // 3)
        bands = [np.bitwise_xor.reduceat(np.where(letter % 3 == k, bit, 0), first).astype(np.int32) for k in range(3)]
        columns = [*batch.columns, pa.array(size.astype(np.int32)), *map(pa.array, bands)]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "length", "m0", "m1", "m2"])


def masks(words: DataFrame) -> DataFrame:
    """(word, n) with length and the three bands m0, m1, m2; without null and empty words."""
    return words.select("word", F.col("n").cast("long").alias("n")).where("length(word) > 0").mapInArrow(_masked, "word string, n long, length int, m0 int, m1 int, m2 int")


def _places() -> Column:
    """The buckets of a word: kind 0, words of one length and one equal band; kind 1, a word (side 0) and those one letter longer (side 1), two equal bands."""
    out = []
    for k in range(3):
        a, b = (f"m{j}" for j in range(3) if j != k)
        for kind, v1, v2, shorter, side in ((0, f"m{k}", None, 0, 0), (1, a, b, 0, 0), (1, a, b, 1, 1)):
            values = [F.lit(kind), F.lit(k), F.col(v1), F.col(v2) if v2 else F.lit(0), F.col("length") - shorter, F.lit(side)]
            out.append(F.struct(*(v.alias(c) for v, c in zip(values, [*_KEY, "side"], strict=True))))
    return F.inline(F.array(*out))


def _tiled(masked: DataFrame) -> DataFrame:
    """Words with the tiles (i, j) of their buckets that they belong to, and their block."""
    rows = masked.select(_places(), "word", "n", "m0", "m1", "m2")
    sizes = rows.groupBy(*_KEY).agg(F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1"))
    sizes = sizes.where("(kind = 0 AND c0 > 1) OR (kind = 1 AND c0 > 0 AND c1 > 0)")
    most = F.greatest(F.lit(1), F.least(F.lit(_BLOCK), F.lit(_BLOCK_CHARS) / F.greatest("length", F.lit(1)))).cast("long")
    sizes = sizes.select(*_KEY, F.ceil(F.col("c0") / most).alias("b0"), F.ceil(F.col("c1") / most).alias("b1"))
    rows = rows.join(sizes, _KEY)
    own = F.pmod(F.xxhash64("word"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1")))
    rows = rows.withColumn("block", own)
    upto = F.when((F.col("kind") == 1) & (F.col("side") == 0), F.col("b1")).otherwise(F.col("b0"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), upto - 1))
    rows = rows.withColumn("other", other)
    i = F.when(F.col("kind") == 0, F.least("block", "other")).when(F.col("side") == 0, F.col("block")).otherwise(F.col("other"))
    j = F.when(F.col("kind") == 0, F.greatest("block", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("block"))
    left = F.when(F.col("kind") == 0, F.col("block") == i).otherwise(F.col("side") == 0)
    return rows.select(*_KEY, i.alias("i"), j.alias("j"), left.alias("on_left"), "word", "n", "m0", "m1", "m2")


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _lead(equal: np.ndarray) -> np.ndarray:
    """How many leading entries of each row are true."""
    return np.where(equal.all(axis=1), equal.shape[1], np.argmin(equal, axis=1))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters are exactly one edit apart; b's are as long as a's or one letter longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    return _lead(a == b[:, :-1]) + _lead((a == b[:, 1:])[:, ::-1]) >= a.shape[1]


def _compared(kind: int, band: int, length: int, same: bool, left: list[str], right: list[str], ml: np.ndarray, mr: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of near words of a tile, each pair once. same: left and right are one block. ml, mr: a row of masks for each band."""
    cl, cr = _codes(left, length), _codes(right, length + kind)
    # What may still differ: of one length the other two bands, by two bits at most; else the band that is not in the key, by one.
    pack = (lambda m: m[band]) if kind else (lambda m: m[(band + 1) % 3] | (m[(band + 2) % 3] << 32))
    xl, xr = pack(ml), pack(mr)
    some = max(1, _PAIRS // max(1, len(right)))
    many = max(1, _BLOCK_CHARS * 4 // max(1, length))
    for k in range(0, len(left), some):
        p, q = np.nonzero(np.bitwise_count(xl[k : k + some, None] ^ xr[None, :]) <= (1 if kind else 2))
        p += k
        keep = p < q if same else np.ones(len(p), bool)
        if not kind:
            for before in range(band):
                keep &= ml[before][p] != mr[before][q]  # else an earlier band has this pair
        p, q = p[keep], q[keep]
        for c in range(0, len(p), many):
            hit = _near(cl[p[c : c + many]], cr[q[c : c + many]])
            yield p[c : c + many][hit], q[c : c + many][hit]


def _tile(rows: pa.Table) -> pa.RecordBatch | None:
    """word, n_near, best_n, best of one tile's words that have near ones there."""
    kind, band, length, i, j = (rows.column(c)[0].as_py() for c in ("kind", "band", "length", "i", "j"))
    on_left = rows.column("on_left").to_numpy()
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    m = np.stack([rows.column(f"m{k}").to_numpy() for k in range(3)]).astype(np.int64)
    same = kind == 0 and i == j
    left = np.flatnonzero(on_left)
    right = left if same else np.flatnonzero(~on_left)
    found = list(_compared(kind, band, length, same, [words[k] for k in left], [words[k] for k in right], m[:, left], m[:, right]))
    a = left[np.concatenate([f[0] for f in found])] if found else left[:0]
    b = right[np.concatenate([f[1] for f in found])] if found else right[:0]
    if not len(a):
        return None
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    has = np.unique(a)
    order = np.array(sorted(has.tolist(), key=lambda k: (-n[k], words[k])))  # pairs go both ways, so every near word is here
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(len(words), len(order))
    np.minimum.at(best, a, rank[b])
    top = order[best[has]]
    columns = [pa.array([words[k] for k in has]), pa.array(np.bincount(a, minlength=len(words))[has]), pa.array(n[top]), pa.array([words[k] for k in top])]
    return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the tiles of a partition, which is sorted by tile; only the rows of one tile and one batch are held."""
    key = [*_KEY, "i", "j"]
    open_: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        values = [rows.column(c).to_numpy() for c in key]
        fresh = np.zeros(len(rows), bool)
        for v in values:
            fresh[1:] |= v[1:] != v[:-1]
        fresh[0] = tuple(int(v[0]) for v in values) != last
        last = tuple(int(v[-1]) for v in values)
        starts = np.flatnonzero(fresh)
        begin = 0
        for at in [*starts.tolist(), len(rows)]:
            if at > begin:
                open_.append(rows.slice(begin, at - begin))
            if at < len(rows) and open_:
                if (out := _tile(pa.concat_tables(open_))) is not None:
                    yield out
                open_ = []
            begin = at
    if open_ and (out := _tile(pa.concat_tables(open_))) is not None:
        yield out
    open_ = []
    pa.default_memory_pool().release_unused()


def near_words(words: DataFrame, store: Store) -> DataFrame:
    """(word, n_near, best_n, best) of the words with near ones: how many, and the most frequent of them, the first in code-point order of equals.

    words: distinct words with their counts n. store keeps a table that is read twice.
    """
    key = [*_KEY, "i", "j"]
    tiles = _tiled(store(masks(words))).repartition(*key).sortWithinPartitions(*key)
    found = tiles.mapInArrow(_tiles, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def rooted(forms: DataFrame, store: Store) -> DataFrame:
    """(word, form) with root, where following forms ends; forms must not run in circles."""
    links = store(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # every round doubles the steps that a root lies ahead
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = store(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not links.where("moved").limit(1).count():
            break
        links = links.drop("moved")
    return forms.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words; form: the most frequent near word, if it is `times` as frequent at least.

    The result is a table in the shared folder; tables on the way are deleted.
    """
    with scratch(docs.sparkSession) as store:
        words = store(vocabulary(docs, min_length, min_count))
        near = near_words(words, store)
        fits = F.col("best_n") >= times * F.col("n")
        forms = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
        return stored(rooted(store(forms), store).select("word", "form", "root", "n", "n_near", "form_n"))
