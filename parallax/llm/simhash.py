"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: the majority of the XXH64 bits of a text's word shingles. Two fingerprints are
linked if they differ in `max_bits` bits or fewer; a component is what links reach.

1. Equal fingerprints are one node, represented by the smallest doc_id (map-side combined).
2. Top of the index: the 64 bits are cut into max_bits + 1 masks. Linked fingerprints agree on
   at least one mask, so each node joins one masked pattern per mask, and only nodes that share
   a pattern can be linked. A pattern that too many nodes share is refined: the bits outside
   its mask are cut again in the same way, until few nodes or few free bits are left. This is
   exact at every level.
3. Below a shared pattern, fingerprints are sorted by Gray rank and packed into a tree whose
   nodes hold the bits on which all members agree, less what the ancestors hold. A search adds
   up differences on the way down and drops whole groups once the sum exceeds max_bits.
4. A pattern's links are reduced to a forest (one edge per node), so that edges grow with the
   nodes, never with pairs. Components are then found by alternating large-star and small-star
   rounds on stored tables.

`near_dups` links by fingerprint alone. `similar_docs` links texts whose shingle sets are similar:
links of the index come first, each checked on whole texts; a sketch of the shingles supplies the
pairs that are similar enough although their fingerprints are further apart (a similarity of 0.8
leaves ten of 64 bits different, a radius at which an index over fingerprints ends up comparing
all with all). Every candidate is measured on whole texts, but those that links already connect.

Defined cases: a null or empty text has fingerprint zero; fewer words than a shingle count as
one shingle; texts of any length are hashed block by block; rows with a null doc_id are linked
like others but represent a component only if all its rows lack an id; rows that repeat an id
share its component; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parallax.llm.common import discard, few_or_merged, map_arrow, materialise, prefix_sum, slices, unused_names

SEED = 42
#: Bytes of a text that are cut into words at once; nodes of one pattern before it is refined; free bits at which refining ends.
TEXT_BLOCK, MAX_GROUP, FREE_BITS = 1 << 20, 1 << 16, 16
#: Members of a tree node; groups up to SCAN are compared by shifting.
FANOUT, SCAN = 8, 16


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in runs from about TEXT_BLOCK bytes each."""
    raw = (text or "").encode().lower()  # bytes: only ASCII letters and ASCII white space
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + TEXT_BLOCK)
        end = cut.start() if cut else len(raw)
        if parts := raw[at:end].split():
            yield parts
        at = end


def _windows(parts: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each run of so many words; `parts` has that many at least."""
    from xxhash import xxh64_intdigest

    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def shingle_blocks(blocks: Iterable[list[bytes]], words: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text, repeats included, one array for each block of words."""
    from xxhash import xxh64_intdigest

    held: list[bytes] = []
    some = False
    for parts in blocks:
        held = [*held, *parts] if held else parts
        if len(held) >= words:
            some = True
            yield _windows(held, words)
            held = held[len(held) - words + 1 :]
    if held and not some:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, highest bit first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total


def majority(ones: np.ndarray, count: int) -> int:
    """The bits that over half of the hashes have."""
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3) -> int:
    ones, count = np.zeros(64, np.int64), 0
    for hashes in shingle_blocks(word_blocks(text), words):
        ones += _ones(hashes)
        count += len(hashes)
    return majority(ones, count)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp), fp as signed 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty(batch.num_rows, np.uint64)
            texts = batch.column(1)
            for i in range(batch.num_rows):
                found[i] = fingerprint(texts[i].as_py(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each value in the Gray code sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Tree over distinct fingerprints in Gray order."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        ones, zeros = fps, ~fps  # bits that all members have, and that none has
        agree = [ones | zeros]
        pattern = [fps]
        while len(ones) > FANOUT:
            cuts = np.arange(0, len(ones), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
            agree.append(ones | zeros)
            pattern.append(ones)
        self.pattern = pattern
        # each node keeps only the bits that its parent does not hold
        self.mask = [agree[-1]] if len(agree) == 1 else [a & ~np.repeat(up, FANOUT)[: len(a)] for a, up in zip(agree, agree[1:], strict=False)] + [agree[-1]]

    def links(self, most: int, room: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, that differ in `most` bits or fewer, for one block of queries after another; a block compares `room` pairs at most."""
        block = max(16, min(4096, room // max(1, len(self.fps))))
        for start in range(0, len(self.fps), block):
            queries = np.arange(start, min(start + block, len(self.fps)))
            top = len(self.pattern[-1])
            q, node = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
            spent = np.zeros(len(q), np.int64)
            for level in range(len(self.pattern) - 1, -1, -1):
                spent = spent + np.bitwise_count((self.fps[q] ^ self.pattern[level][node]) & self.mask[level][node])
                # members of a node follow it in order: nodes wholly before the query hold only smaller positions
                live = (spent <= most) & ((node + 1) * FANOUT**level > q)
                q, node, spent = q[live], node[live], spent[live]
                if level:
                    q, spent = np.repeat(q, FANOUT), np.repeat(spent, FANOUT)
                    node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    real = node < len(self.pattern[level - 1])
                    q, node, spent = q[real], node[real], spent[real]
            later = node > q
            if later.any():
                yield q[later], node[later]


def _forest(size: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each position the smallest one that links reach."""
    root = np.arange(size)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            if np.array_equal(x, y):
                break
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while not np.array_equal(root, up := root[root]):
                root = up
    return root


def links_of_group(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each fingerprint of one group that links to a smaller position."""
    fps = fps[np.argsort(gray_rank(fps), kind="stable")]
    root = _forest(len(fps), GrayIndex(fps).links(most))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def _edges_of_rows(starts: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges within each run."""
    sizes = np.diff(np.r_[starts, len(fps)])
    run = np.repeat(np.arange(len(starts)), sizes)
    small = sizes[run] <= SCAN
    for shift in range(1, min(SCAN, int(sizes.max(initial=0)))):
        near = small[shift:] & (run[shift:] == run[:-shift]) & (np.bitwise_count(fps[shift:] ^ fps[:-shift]) <= most)
        if near.any():
            at = np.flatnonzero(near)
            yield fps[at + shift], fps[at]
    for k in np.flatnonzero(sizes > SCAN):
        a, b = links_of_group(fps[starts[k] : starts[k] + sizes[k]], most)
        if len(a):
            yield a, b


KEY = ["word", "mask", "pattern"]


def _search(rows: DataFrame, groups: Callable[..., Iterator[tuple[np.ndarray, ...]]], schema: str, key: list[str] = KEY, order: Sequence[str] = ()) -> DataFrame:
    """What `groups` makes of the rows, whose columns it gets as arrays, `key` first: whole patterns, each in one run of equal keys."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in chain(batches, [None]):
            now = held
            if batch is not None:
                columns = [np.asarray(c).astype(np.int64).view(np.uint64) for c in batch.columns]
                now = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if now is None or not len(now[0]):
                continue
            # the last pattern may go on in the next batch
            cut = len(now[0]) if batch is None else int(_starts(now, len(key))[-1])
            held = [x[cut:] for x in now]
            for found in groups(_starts([x[:cut] for x in now], len(key)) if cut else np.empty(0, np.int64), *(x[:cut] for x in now)):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.uint64).view(np.int64)) for x in found], names)

    return map_arrow(rows.repartition(*key).sortWithinPartitions(*key, *order), run, schema)


def _starts(columns: list[np.ndarray], keys: int) -> np.ndarray:
    """Where each run of equal keys starts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns[:keys]:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


ALL_BITS = (1 << 64) - 1


def masks(most: int, spare: int = 1, within: int = ALL_BITS) -> list[int]:
    """Masks over `within` of which two values that differ in `most` bits there agree on one at least.

    The bits are cut into most + spare parts of near-equal size; `spare` parts make a mask.
    """
    bits, parts = [i for i in range(64) if within >> i & 1], most + spare
    cut = [round(k * len(bits) / parts) for k in range(parts + 1)]
    part = [sum(1 << i for i in bits[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    return [sum(some) for some in combinations(part, spare)]


def _by_patterns(nodes: DataFrame, words: list[str], most: int, spare: int, max_group: int, free_bits: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`search` over all patterns of the index: rows (word, mask, pattern, columns of `nodes`), hot patterns refined."""
    spark, payload = nodes.sparkSession, nodes.columns
    level = masks(most, spare)
    tops = F.array(*(F.struct(F.lit(k).cast("long").alias("word"), F.lit(_signed(m)).cast("long").alias("mask"), F.lit(_signed(m)).cast("long").bitwiseAND(F.col(w)).alias("pattern")) for k, w in enumerate(words) for m in level))
    rows = nodes.select(F.explode(tops).alias("_t"), *payload).select("_t.*", *payload)
    found: list[DataFrame] = []
    while True:
        open_masks = [m for m in level if 64 - m.bit_count() > free_bits]
        hot = materialise(rows.where(F.col("mask").isin([_signed(m) for m in open_masks])).groupBy(*KEY).count().where(F.col("count") > max_group).select(*KEY), "hot-patterns")
        if not open_masks or hot.isEmpty():
            found.append(search(rows))
            break
        found.append(search(rows.join(hot, KEY, "left_anti")))
        # the masks are a fixed handful
        deeper = [(m, m | s) for m in open_masks for s in masks(most, 1, ALL_BITS & ~m)]
        finer = F.broadcast(spark.createDataFrame([(_signed(a), _signed(b)) for a, b in deeper], "mask long, finer long"))
        value = F.element_at(F.array(*words), (F.col("word") + 1).cast("int"))
        rows = rows.join(hot, KEY, "left_semi").join(finer, "mask").select("word", F.col("finer").alias("mask"), F.col("finer").bitwiseAND(value).alias("pattern"), *payload)
        rows = materialise(rows.distinct(), "finer-patterns")
        level = sorted({b for _, b in deeper})
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


#: Random fingerprints that may share a pattern.
SHARING = 1024


def spare_parts(nodes: int, most: int) -> int:
    """How many of the parts that 64 bits are cut into a mask needs for patterns that few of so many random fingerprints share."""
    return next((s for s in range(1, 8) if nodes >> (64 * s // (most + s)) <= SHARING), 8)


def edges(nodes: DataFrame, most: int, max_group: int = MAX_GROUP, spare: int = 1) -> DataFrame:
    """(u, v): a forest of links within each pattern of the index; nodes: distinct fp."""

    def groups(starts: np.ndarray, _word: np.ndarray, _mask: np.ndarray, _pattern: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        return _edges_of_rows(starts, fps, most)

    return _by_patterns(nodes.select("fp"), ["fp"], most, spare, max_group, FREE_BITS, lambda rows: _search(rows, groups, "u long, v long"))


#: Edges that one task may hold.
FEW_EDGES = 1 << 14


def _components_of_few(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([np.asarray(c) for c in batch.columns]) for batch in batches]
        if ends:
            (u, v) = np.concatenate(ends, axis=1)
            names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = _forest(len(names), iter([(place[: len(u)], place[len(u) :])]))
            moved = np.flatnonzero(root != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["node", "root"])

    return map_arrow(edges.coalesce(1), run, "node long, root long")


def components(pairs: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) of every node that is in an edge and not its own root; root: the smallest node reached.

    Up to `few` edges are connected in one task, more by rounds over stored tables.
    """
    current = materialise(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if current.count() <= few:
        return materialise(_components_of_few(current), "roots")
    state = None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(seen)
        # large star: the larger neighbours of each node go to its smallest one
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        # small star: the smaller neighbours of each node, and the node, go to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        current = materialise(small.where("u <> v").distinct(), "small-star")


def near_dups(docs: DataFrame, words: int = 3, max_bits: int = 2, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of `docs`; component_id is the smallest doc_id reachable."""
    fps = materialise(fingerprints(docs, words), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(edges(nodes.select("fp"), max_bits, max_group))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    smallest = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    classes = materialise(rooted.join(smallest.hint("merge"), "root").select("fp", "component_id"), "classes")
    return fps.join(classes.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# --- documents whose shingles are alike ------------------------------------------------------

#: Words of a shingle, least Jaccard similarity, bits in which fingerprints that the index links may differ.
SHINGLE, SIMILAR, LINK_BITS = 5, 0.8, 5
#: Minima in a band, bands: texts of similarity s share a bucket with probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.8.
ROWS, BANDS = 5, 20
#: Nodes of a bucket that one task holds with those that its window reaches.
MAX_BUCKET = 1024
#: Shingles of one text whose minima are taken at once; how much wider each round's window is than the last.
SKETCH_CHUNK, WIDEN = 1 << 12, 4
#: Classes in which a text's shingles are counted (one byte each, eight to a column); pairs whose counts are compared at once.
CLASSES, COMPARE = 256, 1 << 14
#: Odd factors: multiplied by each, the shingle hashes come in another order.
FACTORS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_key(text: str | None) -> bytes:
    """Key of the word sequence."""
    return _scanned(text, 1 << 60)[0]


def _scanned(text: str | None, shingle: int) -> tuple[bytes, list[np.ndarray]]:
    """Key of the word sequence, and the hashes of all shingles by block."""
    from xxhash import xxh3_128

    key = xxh3_128()

    def keyed() -> Iterator[list[bytes]]:
        for parts in word_blocks(text):
            key.update(b" ".join(parts) + b" ")
            yield parts

    blocks = list(shingle_blocks(keyed(), shingle))
    return key.digest(), blocks


def _set_of(blocks: list[np.ndarray]) -> bytes:
    return np.unique(np.concatenate(blocks) if blocks else np.empty(0, np.uint64)).astype("<u8").tobytes()


def shingle_set(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The sorted hashes of a text's different shingles."""
    return _set_of(list(shingle_blocks(word_blocks(text), shingle)))


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two shingle sets; 1 if both are empty."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def sketch(shingles: bytes) -> list[int]:
    """The bucket of a shingle set in each band: a hash of the least values of its shingles in ROWS orders."""
    from xxhash import xxh64_intdigest

    hashes, least = np.frombuffer(shingles, "<u8"), np.full(ROWS * BANDS, ALL_BITS, np.uint64)
    for i in range(0, len(hashes), SKETCH_CHUNK):
        least = np.minimum(least, (FACTORS[:, None] * hashes[i : i + SKETCH_CHUNK]).min(axis=1))
    return [xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def class_counts(shingles: bytes) -> np.ndarray:
    """How many shingles fall in each class, as bytes; all 255 if a class has more, which leaves every bound open."""
    counts = np.bincount(np.frombuffer(shingles, np.uint8)[::8], minlength=CLASSES)
    return counts.astype(np.uint8) if counts.max() <= 255 else np.full(CLASSES, 255, np.uint8)


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the shingles that each pair of rows of class counts shares."""
    shared = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    full = (a == 255).all(axis=1) | (b == 255).all(axis=1)
    return np.where(full, np.iinfo(np.int64).max, shared)


BUCKETS = [f"b{k}" for k in range(BANDS)]
COUNTS = [f"c{k}" for k in range(CLASSES // 8)]


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, size, fp, b0, b1, ...) of each row; size: different shingles, fp: fingerprint of all."""
    names = ["doc_id", "key", "size", "fp", *BUCKETS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = [], []
            for value in batch.column(1):
                key, blocks = _scanned(value.as_py(), shingle)
                shingles = _set_of(blocks)
                keys.append(key)
                numbers.append([len(shingles) // 8, majority(sum(map(_ones, blocks), np.zeros(64, np.int64)), sum(map(len, blocks))), *sketch(shingles)])
            columns = np.array(numbers, np.uint64).reshape(-1, BANDS + 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), *(pa.array(columns[:, k]) for k in range(BANDS + 2))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, f"doc_id long, key binary, size long, fp long, {', '.join(f'{b} long' for b in BUCKETS)}")


def _forest_of(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs make up a forest over positions below `size`."""
    root, chosen = np.arange(size), []
    at = np.arange(len(a))
    while len(at := at[root[a[at]] != root[b[at]]]):
        x, y = root[a[at]], root[b[at]]
        high, low = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]  # each root hooks on to one smaller root
        chosen.append(at[first])
        root[high[first]] = low[first]
        while not np.array_equal(root, up := root[root]):
            root = up
    return np.concatenate(chosen) if chosen else np.empty(0, np.int64)


def index_pairs(nodes: DataFrame, most: int, max_group: int) -> DataFrame:
    """(u, v) of nodes whose fingerprints the index links: a forest over fingerprints, and the nodes of one fingerprint to the first of them."""
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "first-nodes")
    links = materialise(edges(first.select("fp"), most, max_group, spare_parts(first.count(), most)), "index-links")
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    across = links.join(end("u"), "u").join(end("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    equal = nodes.join(few_or_merged(materialise(first.where("n > 1").select("fp", "first"), "shared-fingerprints")), "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    return across.unionByName(equal)


PAIR = "u long, v long, u_root long, v_root long"


def _mixed(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """(bucket, n) of the buckets whose nodes are not all connected yet; how many there are, and the largest n."""
    stats = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    found = materialise(stats.where("low < high").select("bucket", "n"), "mixed-buckets")
    many, largest = found.agg(F.count(F.lit(1)), F.max("n")).first()
    return found, many, largest or 0


def bucket_members(nodes: DataFrame, max_bucket: int) -> tuple[DataFrame, int]:
    """(bucket, n, size, node, root, pos) of the nodes of mixed buckets, and the largest n; nodes: (node, root, size, b0, b1, ...).

    pos numbers the nodes of a bucket of more than `max_bucket` by (size, node); it is null in others.
    """
    rows = nodes.select(F.explode(F.array(*BUCKETS)).alias("bucket"), "size", "node", "root")
    mixed, many, largest = _mixed(rows)
    members = materialise(rows.join(few_or_merged(mixed, many), "bucket").select("bucket", "n", "size", "node", "root"), "members")
    if largest <= max_bucket:
        return members.withColumn("pos", F.lit(None).cast("long")), largest
    hot = members.where(F.col("n") > max_bucket).withColumn("_salt", F.floor(F.pmod("node", F.lit(1 << 33)) / 1024).cast("long"))
    hot = prefix_sum(hot, ["bucket"], ["size", "_salt"], ["node"], {"pos": F.lit(1)}).drop("_salt")
    cool = members.where(F.col("n") <= max_bucket).withColumn("pos", F.lit(None).cast("long"))
    return materialise(cool.unionByName(hot.select(*cool.columns)), "numbered-members"), largest


def _alike(size: np.ndarray, classes: np.ndarray, one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows may be similar by their sizes and class counts."""
    out = np.minimum(size[one], size[two]) / np.maximum(np.maximum(size[one], size[two]), 1) >= least
    at = np.flatnonzero(out)
    for k in range(0, len(at), COMPARE):
        a, b = one[at[k : k + COMPARE]], two[at[k : k + COMPARE]]
        shared = np.minimum(np.minimum(size[a], size[b]), most_shared(classes[a], classes[b]))
        out[at[k : k + COMPARE]] = shared / np.maximum(size[a] + size[b] - shared, 1) >= least
    return out


def window_pairs(members: DataFrame, low: int, high: int, least: float, max_bucket: int, largest: int) -> DataFrame:
    """(u, v, u_root, v_root): nodes of a bucket, `low` to `high` - 1 places apart by size, that are not connected yet, u < v, with their roots.

    A pair is left out only if its sizes or class counts prove that its similarity is below `least`.
    Buckets of more than `max_bucket` nodes are cut into blocks of that many places: a task holds the
    nodes of one block and those that the window of the block reaches.
    """

    def paired(size: np.ndarray, node: np.ndarray, root: np.ndarray, counts: tuple[np.ndarray, ...], steps: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        classes, size = np.stack(counts, axis=1).view(np.uint8), size.astype(np.int64)
        for one, two in steps:
            apart = root[one] != root[two]
            one, two = one[apart], two[apart]
            alike = _alike(size, classes, one, two, least)
            if alike.any():
                one, two = one[alike], two[alike]
                one, two = np.where(node[one] < node[two], one, two), np.where(node[one] < node[two], two, one)
                yield node[one], node[two], root[one], root[two]

    def whole(starts: np.ndarray, _bucket: np.ndarray, size: np.ndarray, node: np.ndarray, root: np.ndarray, *counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        sizes = np.diff(np.r_[starts, len(node)])
        run = np.repeat(np.arange(len(starts)), sizes)
        steps = ((at, at + k) for k in range(low, min(high, int(sizes.max(initial=0)))) for at in [np.flatnonzero(run[k:] == run[:-k])])
        yield from paired(size, node, root, counts, steps)

    def blocks(starts: np.ndarray, _bucket: np.ndarray, _block: np.ndarray, pos: np.ndarray, right: np.ndarray, size: np.ndarray, node: np.ndarray, root: np.ndarray, *counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        for a, b in zip(starts, np.r_[starts[1:], len(pos)], strict=False):  # none, if all rows may go on in the next batch
            lefts, rights = np.flatnonzero(right[a:b] == 0) + a, np.flatnonzero(right[a:b] == 1) + a
            if not len(lefts) or not len(rights):
                continue
            begin, first = int(pos[lefts[0]]), int(pos[rights[0]])  # places of either side follow each other without gaps

            def steps(lefts=lefts, rights=rights, begin=begin, first=first) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for k in range(low, high):
                    skip, shift = max(0, first - begin - k), begin + k - first
                    n = min(len(lefts), len(rights) - shift) - skip
                    if n > 0:
                        yield lefts[skip : skip + n], rights[skip + shift : skip + shift + n]

            yield from paired(size, node, root, counts, steps())

    found = _search(members.where("pos IS NULL").select("bucket", "size", "node", "root", *COUNTS), whole, PAIR, ["bucket"], ["size", "node"])
    if largest <= max_bucket:
        return found.distinct()
    hot = members.where("pos IS NOT NULL")
    own, side = F.floor(F.col("pos") / max_bucket).cast("long"), lambda block, right: F.struct(block.alias("block"), F.lit(right).cast("long").alias("right"))
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("pos") - (high - 1)) / max_bucket)).cast("long"), F.floor((F.col("pos") - low) / max_bucket).cast("long"))
    rights = F.when(F.col("pos") >= low, F.transform(reach, lambda k: side(k, 1))).otherwise(F.array().cast("array<struct<block:bigint,right:bigint>>"))
    hot = hot.withColumn("_at", F.explode(F.concat(F.array(side(own, 0)), rights))).select("bucket", "_at.block", "pos", "_at.right", "size", "node", "root", *COUNTS)
    return found.unionByName(_search(hot, blocks, PAIR, ["bucket", "block"], ["right", "pos"])).distinct()


class _Texts:
    """Shingle sets of nodes, made from whole texts when they are asked for."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, shingle: int, least: float):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.nodes, self.shingle, self.least = nodes, shingle, least

    def of(self, asked: DataFrame) -> DataFrame:
        """(node, shingles, c0, c1, ...) of the nodes in a stored table; one document of each node is read."""
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in slices(batch):
                    keys, sets = [], []
                    for value in rows.column(0):
                        key, found = _scanned(value.as_py(), shingle)
                        keys.append(key)
                        sets.append(_set_of(found))
                    counts = np.array([class_counts(x) for x in sets], np.uint8).reshape(-1, CLASSES).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary()), *(pa.array(counts[:, k]) for k in range(len(COUNTS)))], ["key", "shingles", *COUNTS])

        ends = materialise(self.nodes.join(few_or_merged(asked), "node", "left_semi").select("key", "node", "first_id"), "asked-nodes")
        wanted = ends.select(F.col("first_id").alias("_wanted")).distinct()
        texts = self.docs.join(few_or_merged(wanted, ends.count()), F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")
        made = map_arrow(texts.select("text"), run, f"key binary, shingles binary, {', '.join(f'{c} long' for c in COUNTS)}").dropDuplicates(["key"])
        return materialise(made.join(ends.select("key", "node"), "key").select("node", "shingles", *COUNTS), "shingles")

    def links(self, pairs: DataFrame, many: int, sets: DataFrame) -> DataFrame:
        """(u, v): the roots of the pairs that are similar, less the links that others of a batch replace.

        pairs: a stored table (u, v, u_root, v_root) of `many` rows; sets: from of().
        """
        least = self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                alike = batch.filter(pa.array([similarity(a.as_py(), b.as_py()) >= least for a, b in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())).select([0, 1])
                names, place = np.unique(np.concatenate([np.asarray(c) for c in alike.columns]), return_inverse=True)
                yield alike.take(pa.array(_forest_of(len(names), place[: alike.num_rows], place[alike.num_rows :]))).rename_columns(["u", "v"])

        asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        own = sets.select("node", "shingles").join(few_or_merged(asked, 2 * many), "node", "left_semi")
        side = lambda end, name: own.select(F.col("node").alias(end), F.col("shingles").alias(name)).hint("merge")
        return map_arrow(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u_root", "v_root", "a", "b"), run, "u long, v long")


def _moved(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after links between roots: (node, root) of each node that is not its own root."""
    new = components(links)
    before = roots.join(few_or_merged(new.select(F.col("node").alias("root"), F.col("root").alias("_to"))), "root", "left")
    return materialise(before.select("node", F.coalesce("_to", "root").alias("root")).unionByName(new), "roots")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(few_or_merged(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar_docs(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILAR, max_group: int = MAX_GROUP, max_bucket: int = MAX_BUCKET, link_bits: int = LINK_BITS) -> DataFrame:
    """(doc_id, component_id) of each row: documents joined by links of similar shingle sets.

    1. The Gray-order index over the texts' fingerprints links those that differ in `link_bits` or
       fewer; a link counts if the Jaccard similarity of the shingle sets is `least` or more.
    2. Pairs that are similar with fingerprints further apart share a bucket of their sketches.
       Buckets that the index has connected are done. Pairs in the others are measured on whole
       texts, in rounds over wider and wider windows, but those that earlier links connect or class
       counts rule out.
    """
    sigs = materialise(signatures(docs, shingle), "signatures")
    nodes = sigs.groupBy("key").agg(F.min("doc_id").alias("first_id"), *(F.min(c).alias(c) for c in ["size", "fp", *BUCKETS]))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = _Texts(docs, nodes.select("key", "node", "first_id"), shingle, least)

    pairs = index_pairs(nodes.select("node", "fp"), link_bits, max_group)
    pairs = materialise(pairs.withColumns({"u_root": F.col("u"), "v_root": F.col("v")}), "candidates")
    ends = materialise(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "linked-nodes")
    sets = texts.of(ends)
    roots = components(texts.links(pairs, pairs.count(), sets))
    discard(sets, ends, pairs)

    members, largest = bucket_members(_with_roots(nodes.select("node", "size", *BUCKETS), roots), max_bucket)
    if largest:
        sets = texts.of(materialise(members.select("node").distinct(), "candidate-nodes"))
        members = materialise(members.join(sets.select("node", *COUNTS).hint("merge"), "node"), "counted-buckets")
    low, high = 1, 2
    while low < largest:
        pairs = materialise(window_pairs(members, low, high, least, max_bucket, largest), "candidates")
        if many := pairs.count():
            roots = _moved(roots, texts.links(pairs, many, sets))
        # what goes on: buckets with members further apart and more than one component
        further = _with_roots(members.where(F.col("n") > high).drop("root"), roots)
        mixed, many, largest = _mixed(further)
        if many:
            members = materialise(further.join(few_or_merged(mixed.select("bucket"), many), "bucket", "left_semi").select(*members.columns), "buckets")
        low, high = high, min(high * WIDEN, high + max_bucket)
    rooted = materialise(_with_roots(nodes.select("key", "node", "first_id"), roots).select("key", "first_id", "root"), "rooted")
    smallest = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    classes = materialise(rooted.join(smallest.hint("merge"), "root").select("key", "component_id"), "classes")
    return sigs.select("doc_id", "key").join(classes.hint("merge"), "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """The rows of `docs`, all columns, but those that are similar to a document with a smaller id.

    A doc_id goes if all its rows do; rows without an id stay. The ids that go are the small side
    of the last join, which moves no texts while they are few.
    """
    found = similar_docs(docs, shingle, least)
    goes = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("goes")).where("goes")
    (gone,) = unused_names(docs, "_gone")
    goes = materialise(goes.select(F.col("doc_id").alias(gone)), "copies")
    return docs.join(few_or_merged(goes), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
