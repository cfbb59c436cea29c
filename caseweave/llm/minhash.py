"""Near-duplicates by Order MinHash, verified by banded alignment.

A document is a sequence of words (see `common.words_of`). Its k-mers are runs of
five words, each labelled with its occurrence number, so a repeated k-mer counts
as often as it occurs. A sketch takes the `ELL` labelled k-mers with the smallest
hashes and keeps them in text order; equal sketches therefore ask for shared
k-mers in the same order, which follows edit similarity rather than set overlap.
`SKETCHES` sketches are drawn per document, and documents that share one are
candidates. A candidate pair is a link if its word-level edit distance is at most
(1 - SIMILARITY) times the longer length, by a bit-parallel alignment inside the
band of that width. Classes are the connected components of the links.

Scale and skew
* Documents with the same words are one class member: they are collapsed by a
  128-bit digest with partial aggregation before anything is compared. Members are numbered;
  a doc_id never stands for a text, so rows of one doc_id may hold different ones.
* Members that share a sketch form a group. Every member is compared with the
  group's leader, and those that link are connected through it. In groups of up to
  `SMALL` all members that are not yet connected are compared with one another.
* After each level the links found are joined to components over all groups, so
  members that met in one group count as connected in every other; groups of one
  component are done. A larger group that still holds several components is refined by
  the next two sketches, with all its members but the leaders (at refined levels up to
  `LEADERS`, of different components where there are such), as long as a level finds a link for
  one in `GAIN` of its rows. This only connects most of a large group at little cost: two
  members may part at a refinement in every one of the sketches they share.
* So what is left of the large groups, the members of those that still hold several
  components, is joined exactly. A link shares so many of the longer text's words, each
  labelled with its occurrence number, that it has one among the rarest `most` + 1 of both
  texts, `most` being the edits that the length allows (prefix filter; any fixed order of
  the words is exact, rarity makes it quick; words of one component come first and are left out).
  Members are dealt to chunks with about `WORDS` of these words each, all of a word to one chunk (a word
  of more than `BLOCK` members to pairs of blocks), so they are a few rows each and not a row for a word.
  Those that share a word are compared by length and by a bitmap of their labelled words, each bit the parity
  of those in its slot: no more bits differ than words do, and with eight slots or more a word, up to `BITS`, few less.
  What passes is aligned in tiles of two blocks of about `TILE` members, to which a text goes once and not
  for each pair, and a tile leaves out pairs that its links already connect. A member has a row for each block
  in which it has partners: few where pairs are few, but where many texts are just outside the bound of one
  another, these rows and the alignments still grow with the square of their number. Components are thus those of all similar pairs that share a sketch,
  whatever a group's size.
* Texts are shuffled once, for members of shared groups only after that.
* Signatures, pairs, links and components are tables in shared storage; only counts
  reach the driver, `RARITY` counts of words among them.

Defined results: documents without words (null, empty, punctuation only) and rows
with a null doc_id are never linked and always kept; rows of one doc_id with different words are
documents each; of the rows of a class that share its smallest doc_id those with the smallest
digest are kept, repeated rows together; a text of fewer than five words is one k-mer; an empty
table gives an empty result; further columns are ignored by `classes` and kept by
`dedup`.
"""

from __future__ import annotations

import hashlib
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import connected_components, free_name, materialize, slices, table, words_of
from caseweave.llm.neardup_vectors import _slabs

K = 5
SKETCHES = 32
ELL = 2
SIMILARITY = 0.8
SMALL = 16
LEADERS = 4
BLOCK = 4_096
BITS = 16_384
RARITY = 262_144
WORDS = 65_536
GAIN = 16
TILE = 512

_RNG = np.random.default_rng(20_240_229)
_SEEDS = _RNG.integers(1, 2**63, SKETCHES, dtype=np.uint64)[:, None]
_ODD = _RNG.integers(1, 2**63, SKETCHES, dtype=np.uint64)[:, None] | np.uint64(1)
_PLACES = _RNG.integers(1, 2**63, K, dtype=np.uint64) | np.uint64(1)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CELLS = 2_000_000
_PAIRS = 262_144
_HELD = 500_000
_HASHES = 65_536
_DEALT = [
    ("chunk", pa.int64()),
    ("rep", pa.int64()),
    ("home", pa.int64()),
    ("size", pa.int32()),
    ("bits", pa.binary()),
    ("words", pa.list_(pa.int64())),
    ("before", pa.list_(pa.int64())),
    ("low", pa.bool_()),
    ("own", pa.bool_()),
]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def _hashed(words: list[bytes], hashes: dict[bytes, int]) -> np.ndarray:
    """The words' hashes; hashes keeps them between calls."""
    ids = []
    for w in words:
        h = hashes.get(w)
        if h is None:
            if len(hashes) >= _HASHES:
                hashes.clear()
            h = hashes[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    return np.array(ids, np.uint64)


def _labelled(values: np.ndarray) -> np.ndarray:
    """A number for each value and its occurrence number."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    fresh = np.concatenate(([True], values[order][1:] != values[order][:-1]))
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    labels = np.empty(n, np.uint64)
    labels[order] = (np.arange(n) - first).astype(np.uint64)
    return _mix(values + labels * _C1)


def sketches(words: list[bytes], hashes: dict[bytes, int]) -> np.ndarray:
    """SKETCHES int64 numbers; hashes keeps the words' hashes between calls."""
    ids = _hashed(words, hashes)
    k = min(K, len(ids))
    n = len(ids) - k + 1
    kmers = np.zeros(n, np.uint64)
    for j in range(k):
        kmers += ids[j : j + n] * _PLACES[j]
    marked = _labelled(_mix(kmers))
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, _CELLS // n)
    for at in range(0, SKETCHES, step):
        values = (marked[None, :] ^ _SEEDS[at : at + step]) * _ODD[at : at + step]
        values ^= values >> np.uint64(32)
        rows = np.arange(len(values))
        picked = []
        for _ in range(min(ELL, n)):
            least = values.argmin(axis=1)
            picked.append(least)
            values[rows, least] = np.uint64(2**64 - 1)
        sketch = _SEEDS[at : at + step, 0].copy()
        for place in np.sort(np.array(picked), axis=0):
            sketch = _mix(sketch * _C1 + marked[place])
        out[at : at + step] = sketch
    return out.view(np.int64)


def edit_distance_within(a: list, b: list, most: int) -> int | None:
    """The edit distance of two sequences if it is at most `most`, else None.

    Common ends are set aside; the rest is aligned inside a band of 2 * most + 1
    diagonals, one column at a time, with the band's vertical differences held as
    bits of two integers (Hyyro's banded form of Myers' algorithm).
    """
    if abs(len(a) - len(b)) > most:
        return None
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    a, b = a[lo:hi_a], b[lo:hi_b]
    m, n = len(a), len(b)
    if not m or not n:
        return max(m, n)
    if not most:
        return None
    k = min(most, max(m, n))
    where: dict = {}
    for i, x in enumerate(a):
        where.setdefault(x, []).append(i)
    bits = {x: sum(1 << i for i in at) << k for x, at in where.items() if len(at) < 65}
    for x, at in where.items():
        if x not in bits:
            marks = bytearray(m // 8 + 1)
            for i in at:
                marks[i >> 3] |= 1 << (i & 7)
            bits[x] = int.from_bytes(marks, "little") << k
    full = (1 << (2 * k + 1)) - 1
    up, down = full >> k << k, 0
    score = min(k, m)
    for j in range(1, n + 1):
        equal = (bits.get(b[j - 1], 0) >> (j - 1)) & full
        same = (((equal & up) + up) ^ up) | equal | down
        same &= full
        plus = down | (full & ~(same | up))
        minus = same & up
        if j + k <= m:
            score += 1 - (same >> (2 * k) & 1)
            if score > 2 * k + n - m:
                return None
        else:
            t = m - j + k
            if t < 0:
                return None
            score += (plus >> t & 1) - (minus >> t & 1)
        shifted = same >> 1
        up = minus | (full & ~(shifted | plus))
        down = plus & shifted
    return score if score <= most else None


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key binary, bands array<long>) of every document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[bytes, int] = {}
        for batch in slices(batches):
            ids, keys, bands = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if words:
                    ids.append(doc_id)
                    keys.append(hashlib.md5(b" ".join(words)).digest())
                    bands.append(sketches(words, hashes))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(ids) + 1) * SKETCHES, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat))],
                names=["doc_id", "key", "bands"],
            )

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, key binary, bands array<long>")


def _similar(words: list[bytes], bag: Counter, other: list[bytes], similarity: float) -> bool:
    """Whether two texts are a link; bag counts the words of the first."""
    longer = max(len(words), len(other))
    most = int((1 - similarity) * longer + 1e-9)
    # An alignment keeps at most the words both have, so too few of them refute a pair at once.
    shared = sum(min(n, bag[w]) for w, n in Counter(other).items() if w in bag)
    return shared >= longer - most and edit_distance_within(words, other, most) is not None


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, a_home, b_home) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, ta, tb = (batch.column(c).to_pylist() for c in ("a", "ta", "tb"))
            good, known, words, bag = [], None, [], Counter()
            for x, text_a, text_b in zip(a, ta, tb, strict=True):
                if x != known:
                    known, words = x, words_of(text_a)
                    bag = Counter(words)
                good.append(_similar(words, bag, words_of(text_b), similarity))
            yield batch.select(["a", "b", "a_home", "b_home"]).filter(pa.array(good, pa.bool_()))

    of_b = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    of_a = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    both = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "a_home", "b_home", "ta", "tb")
    return both.mapInArrow(run, "a long, b long, a_home long, b_home long")


def _among(rows: DataFrame, small: int) -> DataFrame:
    """Pairs of different homes in groups of at most `small` rows."""
    side = lambda x: rows.where(F.col("n") <= small).select("bucket", F.col("rep").alias(x), F.col("home").alias(f"{x}_home"))
    return side("a").join(side("b"), "bucket").where("a < b and a_home <> b_home").select("a", "b", "a_home", "b_home")


def _mixed(rows: DataFrame) -> DataFrame:
    """rows of the groups that hold several homes."""
    several = rows.groupBy("bucket").agg(F.min("home").alias("least"), F.max("home").alias("most")).where("least <> most")
    return rows.join(several.select("bucket"), "bucket", "left_semi")


def _moved(rows: DataFrame, step: DataFrame) -> DataFrame:
    """rows with their homes as step (id, component) joins them."""
    joined = rows.join(step.withColumnsRenamed({"id": "home", "component": "to"}), "home", "left")
    return joined.withColumn("home", F.coalesce("to", "home")).drop("to")


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, text) of members (rep, doc_id, key), from the rows of docs with that doc_id and these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            own = [hashlib.md5(b" ".join(words_of(t))).digest() == k for k, t in zip(keys, texts, strict=True)]
            yield batch.select(["rep", "text"]).filter(pa.array(own, pa.bool_()))

    given = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    met = given.join(members, "doc_id").select("rep", "key", "text").mapInArrow(run, "rep long, text string")
    return met.groupBy("rep").agg(F.min("text").alias("text"))


def _rarity(texts: DataFrame) -> np.ndarray:
    """How often labelled words of texts fall to each of RARITY places; 0 where all of them are of one home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[bytes, int] = {}
        counts, least, most = np.zeros(RARITY, np.int64), np.full(RARITY, 2**63 - 1), np.full(RARITY, -1)
        for batch in slices(batches):
            for home, text in zip(batch.column("home").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = (_labelled(_hashed(words_of(text), hashes)) % RARITY).astype(np.int64)
                np.add.at(counts, at, 1)
                least[at], most[at] = np.minimum(least[at], home), np.maximum(most[at], home)
        places = np.flatnonzero(counts)
        columns = (places, counts[places], least[places], most[places])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "n", "least", "most"])

    found = texts.select("home", "text").mapInArrow(run, "place long, n long, least long, most long").groupBy("place")
    found = found.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most")
    found = found.select("place", "n").toArrow()
    out = np.zeros(RARITY, np.int64)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out


def _dealt(texts: DataFrame, similarity: float) -> DataFrame:
    """The members (rep, home, text) as rows of chunks, each with those of its rarest labelled words that meet others there.

    A row is chunk, rep, home, size (labelled words), bits (the parities of their slots), words, before (those of earlier
    chunks), low and own. Words are dealt to parts of about `WORDS`, so a member has a row for a part and not for a word. Words
    of more than `BLOCK` members are dealt to pairs of blocks instead, as low or high members, own where both blocks are the same.
    """
    counts = _rarity(texts)
    parts = np.uint64(1 + int((1 - similarity) * counts.sum()) // WORDS)
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[bytes, int] = {}
        for batch in slices(batches):
            rows = []
            for rep, home, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "home", "text")), strict=True):
                marked = _labelled(_hashed(words_of(text), hashes))
                slots = min(BITS, max(1_024, 1 << (8 * len(marked) - 1).bit_length()))
                odd = np.bincount((marked >> np.uint64(32)).astype(np.int64) % slots, minlength=slots) & 1
                member = (rep, home, len(marked), np.packbits(odd.astype(np.uint8)).tobytes())
                n = shared.value[(marked % RARITY).astype(np.int64)]
                order = np.lexsort((marked, n))[: int((1 - similarity) * len(marked) + 1e-9) + 1]
                order = order[n[order] > 0]
                words, blocks = marked[order], -(-n[order] // BLOCK)
                few = words[blocks == 1]
                part = (few >> np.uint64(20)) % parts
                rows += [(int(p), *member, few[part == p].view(np.int64), few[part < p].view(np.int64), True, True) for p in np.unique(part)]
                for word, several in zip(words[blocks > 1], blocks[blocks > 1], strict=True):
                    block, other = _mix(np.array([rep], np.uint64) ^ word) % np.uint64(several), np.arange(several, dtype=np.uint64)
                    lo, hi = np.minimum(block, other), np.maximum(block, other)
                    chunks = _mix(_mix(lo * _C1 + hi) + word).view(np.int64).tolist()
                    word = np.array([word]).view(np.int64)
                    rows += [(chunk, *member, word, few.view(np.int64), low, own) for chunk, low, own in zip(chunks, (lo == block).tolist(), (lo == hi).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_DEALT)], names=[c for c, _ in _DEALT])

    schema = "chunk long, rep long, home long, size int, bits binary, words array<long>, before array<long>, low boolean, own boolean"
    return texts.select("rep", "home", "text").mapInArrow(run, schema)


def _bitmaps(bits: list[bytes]) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """By width in bytes: where a row's bitmap is, and the bitmaps of that width in a quarter of it and whole.

    Rows of twice the width are there too, as halves folded onto one another. A fold is the bitmap of fewer slots.
    """
    widths, out = np.array([len(x) for x in bits]), {}
    for width in np.unique(widths).tolist():
        own, wide = np.flatnonzero(widths == width), np.flatnonzero(widths == 2 * width)
        whole, twice = (np.frombuffer(b"".join([bits[k] for k in rows]), np.uint64).reshape(-1, n * width // 8) for n, rows in ((1, own), (2, wide)))
        at = np.zeros(len(bits), np.int64)
        at[np.concatenate([own, wide])] = np.arange(len(own) + len(wide))
        whole = np.concatenate([whole, twice[:, : width // 8] ^ twice[:, width // 8 :]])
        out[width] = at, [np.bitwise_xor.reduce(whole.reshape(len(whole), 4, -1), axis=1), whole]
    return out


def _alike(left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of left (rep, home) of different homes, all that may be similar by the words they share, as (tile, rep, home, others).

    A member has one row for a tile; others are the members there that it is to be aligned with.
    """
    rows = _dealt(texts.join(left, "rep"), similarity)
    blocks = 1 + left.count() // TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, _ in _slabs(batches, "chunk"):
            chunk, reps, home, size = (slab.column(c).to_numpy() for c in ("chunk", "rep", "home", "size"))
            low, own = (slab.column(c).to_numpy(zero_copy_only=False) for c in ("low", "own"))
            bits = slab.column("bits").to_pylist()
            width, bitmaps = np.array([len(x) for x in bits]), _bitmaps(bits)
            least = size - ((1 - similarity) * size + 1e-9).astype(np.int64)
            before = [set(x) for x in slab.column("before").to_pylist()]

            def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                # The shorter text must reach the words that the longer one has to keep.
                some = (home[i] != home[j]) & (np.minimum(size[i], size[j]) >= np.maximum(least[i], least[j]))
                some &= own[i] | (low[i] != low[j])
                i, j = np.divmod(np.unique(i[some] * len(reps) + j[some]), len(reps))
                kept = [np.zeros((2, 0), np.int64)]
                # Lengths so close have widths of one doubling at most.
                narrow = np.minimum(width[i], width[j])
                for w in np.unique(narrow).tolist():
                    (at, maps), all_i, all_j = bitmaps[w], i[narrow == w], j[narrow == w]
                    for k in range(0, len(all_i), 2**22 // w):
                        x, y = all_i[k : k + 2**22 // w], all_j[k : k + 2**22 // w]
                        for bitmap in maps:
                            apart = np.bitwise_count(bitmap[at[x]] ^ bitmap[at[y]]).sum(axis=1, dtype=np.int64)
                            some = apart <= size[x] + size[y] - 2 * np.maximum(least[x], least[y])
                            x, y = x[some], y[some]
                        kept.append(np.array([x, y]))
                i, j = np.concatenate(kept, axis=1)
                # A pair that shares a word of an earlier chunk is found there.
                some = np.array([before[x].isdisjoint(before[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                return np.array([i[some], j[some]])

            row = np.repeat(np.arange(len(reps)), slab.column("words").value_lengths().to_numpy())
            word = slab.column("words").flatten().to_numpy()
            order = np.lexsort((row, word, chunk[row]))
            row, word = row[order], word[order]
            # Rows of a chunk that share a word stand together: each meets the next, the next but one, and so on.
            at, step, met, found = np.arange(len(row)), 0, [], [np.zeros((2, 0), np.int64)]
            while len(at):
                step += 1
                at = at[at + step < len(row)]
                at = at[(word[at] == word[at + step]) & (chunk[row[at]] == chunk[row[at + step]])]
                met.append(np.array([row[at], row[at + step]]))
                if not len(at) or sum(m.shape[1] for m in met) > _PAIRS:
                    whole = np.concatenate(met, axis=1)
                    found += [near(*whole[:, k : k + _PAIRS]) for k in range(0, whole.shape[1], _PAIRS)]
                    met = []
            i, j = np.concatenate(found, axis=1)
            block = (_mix(reps.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            later = (block[i] > block[j]) | ((block[i] == block[j]) & (reps[i] > reps[j]))
            i, j = np.where(later, j, i), np.where(later, i, j)
            tile, rep, other, of_rep, of_other = np.unique([block[i] * blocks + block[j], reps[i], reps[j], home[i], home[j]], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (rep[1:] != rep[:-1])])[: len(tile)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(tile)), pa.int32()), pa.array(other))
            yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in (tile, rep, of_rep)), lists], names=["tile", "rep", "home", "others"])
            tile, other, of_other = np.unique([tile, other, of_other], axis=1)
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(tile) + 1, np.int32)), pa.array([], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (tile, other, of_other)), none], names=["tile", "rep", "home", "others"])

    parts = rows.repartition("chunk").sortWithinPartitions("chunk")
    parts = parts.mapInArrow(run, "tile long, rep long, home long, others array<long>").groupBy("tile", "rep")
    return parts.agg(F.min("home").alias("home"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("others")))).alias("others"))


def _joined(tiles: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): homes that are joined by similar pairs of tiles (see `_alike`), of each tile fewer rows than it has homes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab, spans in _slabs(batches, "tile"):
            links: list[tuple[int, int]] = []
            for lo, hi in spans:
                reps, home, given, others = (slab.column(c).slice(lo, hi - lo).to_pylist() for c in ("rep", "home", "text", "others"))
                place, held, cached, to = {rep: k for k, rep in enumerate(reps)}, {}, 0, {}

                def root(x: int) -> int:
                    while x in to:  # noqa: B023
                        x = to[x]  # noqa: B023
                    return x

                for k, partners in enumerate(others):
                    words = words_of(given[k]) if partners else []
                    bag = Counter(words)
                    for m in map(place.__getitem__, partners):
                        a, b = root(home[k]), root(home[m])
                        if a == b:
                            continue
                        other = held.get(m)
                        if other is None:
                            other = words_of(given[m])
                            cached += len(other)
                            if cached > _HELD:
                                held, cached = {}, len(other)
                            held[m] = other
                        if _similar(words, bag, other, similarity):
                            to[max(a, b)] = min(a, b)
                            links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    rows = tiles.join(texts, "rep").select("tile", "rep", "home", "others", "text").repartition("tile").sortWithinPartitions("tile")
    return rows.mapInArrow(run, "src long, dst long")


def homes(docs: DataFrame, reps: DataFrame, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """(rep, home) of reps (rep, doc_id, key, bands): home is the smallest rep connected by verified links."""
    rows = reps.select("rep", F.posexplode("bands").alias("pos", "bucket"), F.col("rep").alias("home"))
    groups = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1")
    rows = materialize(rows.join(groups, "bucket"), "omh-groups")
    met = reps.select("rep", "doc_id", "key").join(rows.select("rep").distinct(), "rep")
    texts = materialize(_texts(docs, met), "omh-texts")
    # Everyone meets the leader, which then leaves the group; in a small group all that it does not connect meet.
    led = rows.where(F.col("rep") != F.col("leader"))
    star = led.select(F.col("leader").alias("a"), F.col("rep").alias("b"), F.col("leader").alias("a_home"), F.col("rep").alias("b_home")).distinct()
    near = materialize(_verified(star, texts, similarity), "omh-near")
    joined = near.select(F.col("a").alias("leader"), F.col("b").alias("rep"), F.lit(True).alias("linked"))
    home = F.when(F.col("linked"), F.col("leader")).otherwise(F.col("home"))
    led = materialize(led.join(joined, ["leader", "rep"], "left").select("rep", "pos", "bucket", "n", home.alias("home")), "omh-led")
    few = materialize(_verified(_among(led, small).distinct(), texts, similarity), "omh-few")
    step = connected_components(near.union(few).select(F.col("a").alias("src"), F.col("b").alias("dst")), "omh-components")
    first = reps.select("rep", F.col("rep").alias("home"))
    first = materialize(_moved(first, step), "omh-homes")
    across, depth = None, 0
    large = led.where(F.col("n") > small).select("rep", "pos", "bucket")
    rows = large.join(first, "rep")
    while True:
        rows = _mixed(rows).join(reps.select("rep", "bands"), "rep")
        next_ = lambda k: F.element_at("bands", (F.col("pos") + k) % F.size("bands") + 1)
        finer = F.xxhash64("bucket", next_(depth + 1), next_(depth + 2))
        rows = _mixed(rows.select("rep", "pos", finer.alias("bucket"), "home"))
        depth += 2
        rows = materialize(rows, f"omh-rows-{depth}")
        met = rows.count()
        if not met:
            break
        kind = F.pmod(F.xxhash64("home"), F.lit(LEADERS))
        lead = [F.min(F.when(kind == k, F.struct("rep", "home"))) for k in range(LEADERS)]
        groups = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.array_compact(F.array(*lead)).alias("leaders"))
        rows = materialize(rows.join(groups, "bucket"), f"omh-groups-{depth}")
        to = rows.select("rep", "home", F.explode("leaders").alias("lead")).where((F.col("home") != F.col("lead.home")))
        star = to.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"), F.col("lead.home").alias("a_home"), F.col("home").alias("b_home"))
        near = materialize(_verified(star.union(_among(rows, small)).distinct(), texts, similarity), f"omh-near-{depth}")
        edges = near.select(F.col("a_home").alias("src"), F.col("b_home").alias("dst"))
        across = edges if across is None else across.union(edges)
        # A level that connects few is the last one: the exact join below takes all that is left.
        if near.count() * GAIN < met:
            break
        rows = rows.where((F.col("n") > small) & ~F.exists("leaders", lambda x: x["rep"] == F.col("rep"))).select("rep", "pos", "bucket", "home")
        rows = _moved(rows, connected_components(edges, f"omh-components-{depth}"))
    if across is not None:
        first = materialize(_moved(first, connected_components(across, "omh-across")), "omh-refined")
    # What the refinement has not connected is joined exactly.
    left = materialize(_mixed(large.select("rep", "bucket").join(first, "rep")).select("rep", "home").distinct(), "omh-left")
    if left.isEmpty():
        return first
    tiles = materialize(_alike(left, texts, similarity), "omh-tiles")
    joined = materialize(_joined(tiles, texts, similarity), "omh-rest")
    return _moved(first, connected_components(joined, "omh-rest-components"))


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, key, rep, component_id, kept) of every row with words and a doc_id."""
    sig = materialize(signatures(docs), "omh-signatures")
    reps = sig.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "omh-reps")
    whole = homes(docs, reps, similarity)
    named = reps.select("key", "doc_id", "rep").join(whole, "rep")
    least = named.groupBy("home").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    named = named.join(least, "home").select("key", F.col("doc_id").alias("rep"), "first")
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return sig.select("doc_id", "key").join(named, "key").select("doc_id", "key", "rep", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, rep, component_id, kept) for every row of docs.

    rep is the smallest doc_id with the same words, component_id the smallest
    doc_id of the class.
    """
    found = _classes(docs, similarity).drop("key")
    wordless = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))
    alone = docs.where(wordless).select(F.col("doc_id").cast("long").alias("doc_id"))
    alone = alone.select("doc_id", F.col("doc_id").alias("rep"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def word_digest(text: Column) -> Column:
    """The digest `signatures` gives the words of a text, in Spark's functions."""
    plain = F.trim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return F.unhex(F.md5(F.translate(plain, string.ascii_uppercase, string.ascii_lowercase)))


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs, same columns, with one document of each class."""
    name, key = free_name("cw_gone", docs), free_name("cw_key", docs)
    gone = _classes(docs, similarity).where(~F.col("kept")).select(F.col("doc_id").alias(name), F.col("key").alias(key)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(name)) & (word_digest(F.col("text")) == F.col(key)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
