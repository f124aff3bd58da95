"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct shingles of ``width`` words.  Documents with equal sets form a
class at once; what follows works on one row a class.

*Trees.*  A class's ``POSITIONS`` minwise tokens stand for its set.  In each of ``TREES``
trees a node picks one token position, or with probability ``SECOND`` two of
them, by a hash of the node; the classes at the node branch to one child for each value of a
picked token.  Two classes of Jaccard similarity 0.8 then share 0.8 * (1 + SECOND) = 1
expected child, and meet in some node at depth 3 with probability 0.64 a tree.  Nodes of
more than ``SMALL`` classes branch on, three levels at a time down to ``DEPTH``; the classes
of such nodes also enter ``MORE_TREES`` further trees.  A class
finds its nodes from its own tokens, so a level needs no shuffle; only node sizes do.

*Contraction.*  A large group of near copies would meet in every tree.  So before all trees are
searched, in a few of them (``FIRST_TREES``) each class is compared, on full sets, with one class: the
least, by hash, of those that its nodes put forward and that its sketch allows.  Linked classes are
contracted to a component.  Nodes that lie in one component are then left out of the full search: nothing
can be found there.  This only spares work; no class and no pair of components is given up by it.

*Heavy components.*  A component of ``HEAVY`` classes or more enters a node once, however many of its classes
reach it; only where a node has too many members do its classes branch on one by one.  What shares a
node with a heavy component is compared by sketch with all of that component's classes, once.

*Comparing nodes.*  Within a node classes of different components are compared by size and a four-bit
sketch of the tokens.  Classes that could be linked form groups, and a group goes to its
*home*, the component with most of its classes, each class once however many nodes
found it.  At the home a class of another component is compared with all that is there on full sets, while
the home's own classes aren't compared with each other; so these can be dealt to chunks of
``CHUNK`` shingles, to each of which the others go.  Nodes that are still larger than ``SMALL`` at
the last depth are dealt to blocks in the same way.  Nothing is capped or dropped.

What is sent grows with the number of classes times the homes that they could belong to, and for one home
with (classes of other components) * (chunks of its own).  That product is the quadratic rest: it
is large only where very many classes are alike by sketch and yet not linked.

All trees draw from the same tokens, so they are independent only given how many of them
agree, which is Binomial(POSITIONS, 0.8) for a pair of similarity 0.8.  Summed over that, the
chance that the pair meets in no tree is 1.2e-8 at depth 3, and 1.1e-7 at the last depth with
the further trees; at 0.85 it is 1e-10 and 4e-11.  Components are safer yet, as any chain
of links will do.  ``exact_components`` in the tests is the brute force that this is held to.

Null or wordless texts have an empty set and are linked with nothing.  Rows with a null id
take part but name no component; a component with null ids only has a null id and its rows
are kept.  Repeated rows fall into one class.  Very long texts are sets like others; an empty table
gives an empty result; further columns, whatever their names, are not read.  Shingles are
compared, and whole sets keyed, by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import batches, cut, dropped, first_free, mix64, row_key, shared_dir

POSITIONS, TREES, MORE_TREES, SECOND, DEPTH, SMALL = 256, 20, 30, 0.25, 9, 4096
#: Trees of the contraction that goes before the full search.
FIRST_TREES = 4
#: Classes from which on a component stands as one in the nodes that its classes reach.
HEAVY = 64
LEAST_PERCENT = 80
#: Words of a shingle, unless a caller's contract says otherwise.
WIDTH = 5
#: Tokens that a sketch is made of, four bits each; the first of the positions.
SKETCH = 64
#: Tokens of a sketch's 64 that must agree for a pair to be confirmed: at 0.8 fewer agree once in a million.
LEAST_AGREE = 34
#: Shingles of a home's own sets that are held at once, with ``CLASS_COST`` added for each class.
CHUNK, CLASS_COST = 1 << 16, 64
#: Sketches of a heavy component that are held at once.
SKETCHES = 1024
#: Ids up to this many go out with the tasks that fetch texts; more are joined by a shuffle.
MOST_SENT = 200_000

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)


def lowered_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int = WIDTH) -> set:
    """The set itself: runs of ``width`` neighbouring words, or all words as one if there are fewer."""
    words = lowered_words(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width))))


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    words = lowered_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    run = h[:n]
    for k in range(1, width):
        run = mix64(run) + h[k : k + n] * np.uint64(0x9FB21C651E98DF25)
    return np.unique(mix64(run))


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) >> 1


def tokens_of(hashes: np.ndarray) -> np.ndarray:
    """The minwise token of each position, 16 bits."""
    low = np.full(POSITIONS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 256):
        part = np.multiply.outer(_A, hashes[i : i + 256])
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (mix64(low) >> np.uint64(48)).astype(np.uint16)


def sketch_rows(frames: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Arrow map ``(doc_id, text, row)`` to ``(doc_id, row, n_shingles, u, tokens, e0..e3)``."""
    place = (np.arange(SKETCH, dtype=np.uint64) % np.uint64(16)) * np.uint64(4)
    for batch in batches(frames, 1024):
        sizes, keys, packed, nibbles = [], [], [], []
        for text in batch.column(1).to_pylist():
            hashes = shingle_hashes(text, width)
            sizes.append(len(hashes))
            keys.append(set_key(hashes) if len(hashes) else None)
            tokens = tokens_of(hashes) if len(hashes) else np.zeros(POSITIONS, np.uint16)
            packed.append(tokens.tobytes() if len(hashes) else None)
            four = (tokens[:SKETCH].astype(np.uint64) & np.uint64(15)) << place
            nibbles.append(np.bitwise_or.reduce(four.reshape(4, 16), axis=1).view(np.int64))
        e = np.array(nibbles, np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(packed, pa.binary()), *(pa.array(e[:, i]) for i in range(4))],
            names=["doc_id", "row", "n_shingles", "u", "tokens", "e0", "e1", "e2", "e3"],
        )


def roots(first: int, last: int) -> np.ndarray:
    """The roots of trees ``first`` to ``last - 1``."""
    return mix64(np.arange(first + 1, last + 1, dtype=np.uint64))


def branch(node: np.ndarray, row: np.ndarray, tokens: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Follows all paths of each row some levels down; returns nodes and their rows."""
    for _ in range(levels):
        draw = mix64(node + np.uint64(0x5851F42D4C957F2D))
        first = (draw % np.uint64(POSITIONS)).astype(np.int64)
        again = np.flatnonzero((draw >> np.uint64(40)).astype(np.float64) < SECOND * 2**24)
        step = 1 + ((draw[again] >> np.uint64(16)) % np.uint64(POSITIONS - 1)).astype(np.int64)
        at = np.concatenate([first, (first[again] + step) % POSITIONS])
        row = np.concatenate([row, row[again]])
        parent = np.concatenate([node, node[again]])
        node = mix64(mix64(parent + at.astype(np.uint64)) ^ tokens[row, at].astype(np.uint64))
    return node, row


def _paths(levels: int, trees: tuple[int, int] | None = None):
    """Arrow map to ``(node, u, comp)``: of ``(u, comp, tokens)`` from the roots of trees, or of ``(u, comp, tokens, node)``."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                n = part.num_rows
                keys, comps = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                tokens = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(n, POSITIONS)
                if trees:
                    node = np.repeat(roots(*trees), n)
                    row = np.tile(np.arange(n), trees[1] - trees[0])
                else:
                    node = part.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                    row = np.arange(n)
                node, row = branch(node, row, tokens, levels)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(keys[row]), pa.array(comps[row])], names=["node", "u", "comp"])

    return run


def set_rows(frames: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Arrow map ``(doc_id, text)`` to ``(u, hashes)``, the whole set."""
    for batch in batches(frames, 256):
        sets = [h for t in batch.column(1).to_pylist() if len(h := shingle_hashes(t, width))]
        keys = pa.array([set_key(h) for h in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([keys, pa.array([h.tobytes() for h in sets], pa.binary())], names=["u", "hashes"])


def whole_groups(frames: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches that end with a group of rows of equal first ``keys`` columns, and where groups start."""

    def bounds(batch: pa.RecordBatch) -> list[int]:
        new = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
        return [0, *np.flatnonzero(new).tolist()]

    held: list[pa.RecordBatch] = []  # what the last group has so far, all of one key
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in frames:
        if not batch.num_rows:
            continue
        if held and all(held[0].column(k)[0].equals(batch.column(k)[batch.num_rows - 1]) for k in range(keys)):
            held.append(batch)
            continue
        held.append(batch)
        batch = joined()
        starts = bounds(batch)
        if starts[-1]:
            yield batch.slice(0, starts[-1]), starts[:-1]
        held = [batch.slice(starts[-1])]
    if held:
        yield joined(), [0]


def alike(e: np.ndarray, n: np.ndarray, comp: np.ndarray, rows: slice) -> np.ndarray:
    """Which of ``rows`` could be linked with which others of other components, by size and sketch."""
    z = e[rows, None, :] ^ e[None, :, :]
    z |= z >> np.uint64(1)
    z |= z >> np.uint64(2)
    differ = np.bitwise_count(z & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int64)
    near = differ <= SKETCH - LEAST_AGREE
    near &= 100 * np.minimum(n[rows, None], n) >= LEAST_PERCENT * np.maximum(n[rows, None], n)
    return near & (comp[rows, None] != comp)


def groups_of(n: np.ndarray, e: np.ndarray, comp: np.ndarray) -> list[np.ndarray]:
    """Connected groups of rows of different components that could be linked; about 2^18 pairs are held at once."""
    label, step = np.arange(len(n)), max(16, (1 << 18) // max(1, len(n)))
    while True:
        new = label.copy()
        for i in range(0, len(n), step):
            near = alike(e, n, comp, slice(i, i + step))
            new[i : i + step] = np.minimum(new[i : i + step], np.where(near, label, len(n)).min(axis=1))
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
    return [part for part in parts if len(part) > 1]


def home_of(comps: np.ndarray) -> int:
    """The component with most classes of a group, the least among equals."""
    found, counts = np.unique(comps, return_counts=True)
    return int(found[counts.argmax()])


def group_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map of ``(node, block, u, comp, heavy, n, e0..e3)``, sorted, to ``(home, u, comp, n, light)``.

    ``light`` rows are of groups that sketches found.  The others are to be compared with a heavy
    home; ``u`` is a class or, for a heavy component, that component.
    """
    for batch, starts in whole_groups(frames, 2):
        u, comp, heavy, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5))
        e = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(6, 10)], axis=1).view(np.uint64)
        found = {}
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            at = lo + np.flatnonzero(~heavy[lo:hi])
            for part in groups_of(n[at], e[at], comp[at]) if len(at) > 1 else ():
                home = home_of(comp[at[part]])
                found.update(((home, int(u[i])), i) for i in at[part])
            mains = sorted(u[lo:hi][heavy[lo:hi]].tolist())
            for k, home in enumerate(mains):
                found.update(((home, int(u[i])), i) for i in at if comp[i] != home)
                found.update(((home, int(u[i])), i) for i in range(lo, hi) if heavy[i] and u[i] > home)
        at = np.fromiter(found.values(), np.int64, len(found))
        homes = [home for home, _ in found]
        weighty = set(u[heavy].tolist())
        light = pa.array([h not in weighty for h in homes], pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array(u[at]), pa.array(comp[at]), pa.array(n[at]), light], names=["home", "u", "comp", "n", "light"])


def near_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map of ``(home, chunk, u, comp, everywhere, n, e0..e3)``, sorted, to those that sketches hold to be alike."""
    for batch, starts in whole_groups(frames, 2):
        comp, everywhere, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
        e = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(6, 10)], axis=1).view(np.uint64)
        keep = np.zeros(batch.num_rows, bool)
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            order = lo + np.argsort(~everywhere[lo:hi], kind="stable")
            for i in range(0, int(everywhere[lo:hi].sum()), 256):
                near = alike(e[order], n[order], comp[order], slice(i, min(i + 256, int(everywhere[lo:hi].sum()))))
                keep[order[i : i + len(near)]] |= near.any(axis=1)
                keep[order] |= near.any(axis=0)
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in (0, 2, 3, 5)], names=["home", "u", "comp", "n"])


def links_of(comps: np.ndarray, sets: list[np.ndarray], everywhere: np.ndarray) -> list[tuple[int, int]]:
    """``(component, least component)`` for each component that full sets link to a lesser one.

    Sets marked ``everywhere`` are compared with all sets of other components; the others,
    which are of one component or meet elsewhere, only with those.
    """
    starts = np.cumsum([0, *map(len, sets)])
    size, starts = np.diff(starts), starts[:-1]
    held = np.concatenate(sets)
    names, label = np.unique(comps, return_inverse=True)
    for i in np.flatnonzero(everywhere):
        other = label != label[i]
        other &= 100 * np.minimum(size, size[i]) >= LEAST_PERCENT * np.maximum(size, size[i])
        if not other.any():
            continue
        if other.sum() * 4 < len(sets):
            at = np.flatnonzero(other)
            both = np.array([overlap(sets[i], sets[k]) for k in at])
        else:
            at = slice(None)
            both = np.add.reduceat(inside(held, sets[i]), starts, dtype=np.int64)
        near = other[at] & (100 * both >= LEAST_PERCENT * (size[i] + size[at] - both))
        met = np.unique(np.append(label[at][near], label[i]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    least = names[label]
    return sorted({(int(a), int(b)) for a, b in zip(comps, least) if a != b})


def inside(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return int(inside(a, b).sum())


def link_rows(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map of ``(home, chunk, u, comp, everywhere, hashes)``, sorted, to links ``(a, b)`` of components."""
    for batch, starts in whole_groups(frames, 2):
        links: set[tuple[int, int]] = set()
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
            part = batch.slice(lo, hi - lo)
            _, first = np.unique(part.column(2).to_numpy(zero_copy_only=False), return_index=True)  # a repeated id can bring its class again
            comps, everywhere = (part.column(k).to_numpy(zero_copy_only=False)[first] for k in (3, 4))
            packed = part.column(5)
            links.update(links_of(comps, [np.frombuffer(packed[int(i)].as_buffer(), np.uint64) for i in first], everywhere))
        rows = sorted(links)
        ends = [pa.array([x[k] for x in rows], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(ends, names=["a", "b"])


def _alike(a: str, b: str):
    """The test by size and sketch, of two structs with ``n, e0..e3``, as a column."""
    n = [F.col(f"{x}.n") for x in (a, b)]
    differ = F.lit(0)
    for k in range(4):
        z = F.col(f"{a}.e{k}").bitwiseXOR(F.col(f"{b}.e{k}"))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        differ = differ + F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    return (differ <= SKETCH - LEAST_AGREE) & (100 * F.least(*n) >= LEAST_PERCENT * F.greatest(*n))


class _Join:
    """One run of the join; its tables lie in a folder of their own and go when they are used up."""

    def __init__(self, docs: DataFrame, width: int = WIDTH):
        self.sketched, self.whole = partial(sketch_rows, width=width), partial(set_rows, width=width)
        self.docs = docs.select("doc_id", F.col("text"))
        self.spark, self.folder, self.serial = docs.sparkSession, shared_dir(docs.sparkSession), 0
        self.held: list[str] = []

    def cut(self, df: DataFrame, name: str, stays: bool = False) -> DataFrame:
        self.serial += 1
        name = f"{self.serial:03d}-{name}"
        if not stays:
            self.held.append(name)
        return cut(df, self.folder, name)

    def release(self, mark: int) -> None:
        """Deletes the tables written since ``mark`` that are not to stay."""
        for name in self.held[mark:]:
            dropped(self.spark, f"{self.folder}/{name}")
        del self.held[mark:]

    @staticmethod
    def sent(df: DataFrame) -> DataFrame:
        """``df``, a table of ids, marked for broadcast if it is counted to be small."""
        return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df

    def sketches(self) -> tuple[DataFrame, DataFrame]:
        """All rows with their class, and one row a class."""
        kind, mark = self.docs.schema["doc_id"].dataType.simpleString(), len(self.held)
        schema = f"doc_id {kind}, row bigint, n_shingles bigint, u bigint, tokens binary, e0 bigint, e1 bigint, e2 bigint, e3 bigint"
        made = self.cut(self.docs.withColumn("row", row_key()).mapInArrow(self.sketched, schema), "sketches")
        one = made.where("u IS NOT NULL").groupBy("u").agg(
            F.min("doc_id").alias("rep"),
            F.first(F.struct(F.col("n_shingles").alias("n"), "tokens", "e0", "e1", "e2", "e3")).alias("s"),
        )
        classes = self.cut(one.select("u", "rep", "s.*"), "classes", stays=True)
        rows = self.cut(made.select("doc_id", "row", "n_shingles", "u"), "rows", stays=True)
        self.release(mark)
        return rows, classes

    def sets(self, classes: DataFrame, held: DataFrame) -> DataFrame:
        """``(u, hashes)`` of the classes in ``held``."""
        wanted = classes.select("u", F.col("rep").alias("doc_id")).join(held.select("u").distinct(), "u")
        need = self.cut(wanted.select("doc_id").distinct(), "wanted")
        schema = "u bigint, hashes binary"
        found = self.docs.join(self.sent(need), "doc_id", "left_semi").mapInArrow(self.whole, schema)
        if need.where("doc_id IS NULL").isEmpty():
            return found
        nameless = self.docs.where("doc_id IS NULL").dropDuplicates(["text"]).mapInArrow(self.whole, schema)
        return found.unionByName(nameless.dropDuplicates(["u"]))

    def dealt(self, held: DataFrame, weight, most: int) -> DataFrame:
        """``held`` with ``chunk``: rows not ``everywhere`` are dealt to chunks of their home of about ``most``, the others go to all."""
        large = held.where("NOT everywhere").groupBy("home").agg(F.ceil(F.sum(weight) / most).cast("int").alias("chunks")).where("chunks > 1")
        held = held.join(self.sent(self.cut(large, "large")), "home", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        own = F.array(F.pmod(F.xxhash64("u"), F.col("chunks")).cast("int"))
        return held.withColumn("chunk", F.explode(F.when(F.col("everywhere"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own)))

    def compared(self, classes: DataFrame, held: DataFrame) -> DataFrame:
        """Links ``(a, b)`` of components found in the homes ``held``: ``(home, u, comp, n, everywhere)``."""
        held = self.cut(held, "held")
        dealt = self.dealt(held, F.col("n") + CLASS_COST, CHUNK).select("home", "chunk", "u", "comp", "everywhere")
        rows = dealt.join(self.sets(classes, held), "u").select("home", "chunk", "u", "comp", "everywhere", "hashes")
        rows = rows.repartition("home", "chunk").sortWithinPartitions("home", "chunk")
        return self.cut(rows.mapInArrow(link_rows, "a bigint, b bigint").distinct(), "links")

    def with_component(self, classes: DataFrame, comps: DataFrame | None) -> DataFrame:
        """``classes`` with ``comp``, a class that has no links being its own."""
        if comps is None:
            return classes.withColumn("comp", F.col("u"))
        return classes.join(self.sent(comps), "u", "left").withColumn("comp", F.coalesce("comp", "u"))

    def joined(self, comps: DataFrame | None, links: DataFrame) -> DataFrame:
        """The components ``(u, comp)`` after ``links`` of components."""
        merged = self.components(links).select(F.col("u").alias("was"), F.col("label").alias("now"))
        if comps is None:
            return merged.select(F.col("was").alias("u"), F.col("now").alias("comp"))
        old = comps.join(merged, comps["comp"] == merged["was"], "left").select("u", F.coalesce("now", "comp").alias("comp"))
        return old.unionByName(merged.select(F.col("was").alias("u"), F.col("now").alias("comp"))).dropDuplicates(["u"])

    def contracted(self, classes: DataFrame) -> DataFrame | None:
        """Components ``(u, comp)`` of the classes that are linked with the one put forward to them; None if none is."""
        mark, order = len(self.held), F.xxhash64("u")
        rows = classes.select("u", F.col("u").alias("comp"), "tokens").mapInArrow(_paths(3, (0, FIRST_TREES)), "node bigint, u bigint, comp bigint").select("node", "u")
        tops = rows.groupBy("node").agg(F.min_by("u", order).alias("top"), F.count("*").alias("size")).where("size > 1").select("node", "top")
        near = rows.join(tops, "node").where("u <> top").select("u", "top").distinct()
        sketch = F.struct("n", "e0", "e1", "e2", "e3")
        near = near.join(classes.select("u", sketch.alias("own")), "u").join(classes.select(F.col("u").alias("top"), sketch.alias("its")), "top").where(_alike("own", "its"))
        chosen = near.groupBy("u").agg(F.min_by(F.struct("top", F.col("own.n").alias("n"), F.col("its.n").alias("top_n")), F.xxhash64("top")).alias("c"))
        pairs = self.cut(chosen.select("u", "c.*"), "pairs")
        if pairs.isEmpty():
            return None
        tops = pairs.select(F.col("top").alias("home"), F.col("top").alias("u"), F.col("top").alias("comp"), F.col("top_n").alias("n"), F.lit(True).alias("everywhere")).distinct()
        links = self.compared(classes, tops.unionByName(pairs.select(F.col("top").alias("home"), "u", F.col("u").alias("comp"), "n", F.lit(False).alias("everywhere"))))
        comps = None if links.isEmpty() else self.cut(self.joined(None, links), "comps", stays=True)
        self.release(mark)
        return comps

    def meeting(self, rows: DataFrame, name: str) -> DataFrame:
        """Of ``(node, u, comp)`` those of nodes with more than one component, with the node's size."""
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        return self.cut(rows.join(sizes.where("lo <> hi").select("node", "size"), "node"), name)

    def level(self, light: DataFrame, heavy: DataFrame | None, name: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """The members of nodes at a level; of nodes larger than ``SMALL``, the classes (light, heavy) that reach them."""
        rows = light.withColumn("heavy", F.lit(False))
        if heavy is not None:
            rows = rows.unionByName(heavy.select("node", F.col("comp").alias("u"), "comp").distinct().withColumn("heavy", F.lit(True)))
        met = self.meeting(rows, name)
        if met.where(F.col("size") > SMALL).isEmpty():
            return met, None, None
        large = self.sent(self.cut(met.where(F.col("size") > SMALL).select("node").distinct(), "large"))
        return met, light.join(large, "node"), heavy if heavy is None else heavy.join(large, "node")

    def members(self, classes: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
        """``(node, u, comp, heavy, size)`` for the nodes that are compared, each of two components or more.

        ``classes``: those of light components; ``heavy``: those of heavy ones.
        """
        kind = "node bigint, u bigint, comp bigint"
        of = lambda df, trees: df if df is None else df.select("u", "comp", "tokens").mapInArrow(_paths(3, trees), kind)
        trees = (0, TREES)
        met, light, weighty = self.level(of(classes, trees), of(heavy, trees), "depth3")
        if light is None:
            return met
        parts, reached = [met], [(light, weighty)]
        if MORE_TREES:
            crowded = met.where(F.col("size") > SMALL).select(F.col("u").alias("unit")).distinct()
            at = lambda df, unit: df if df is None else df.join(crowded, df[unit] == crowded["unit"], "left_semi")
            trees = (TREES, TREES + MORE_TREES)
            more, light, weighty = self.level(of(at(classes, "u"), trees), of(at(heavy, "comp"), trees), "further3")
            parts.append(more)
            if light is not None:
                reached.append((light, weighty))
        for depth in range(6, DEPTH + 1, 3):
            parts = [p.where(F.col("size") <= SMALL) for p in parts]
            deeper = []
            for side, source in enumerate((classes, heavy)):
                if source is None:
                    deeper.append(None)
                    continue
                rows = self._union([r[side] for r in reached]).select("node", "u").join(source.select("u", "comp", "tokens"), "u")
                rows = rows.select("u", "comp", "tokens", "node").repartition("u", "node")  # a class of many large nodes branches in many tasks
                deeper.append(rows.mapInArrow(_paths(3), kind))
            met, light, weighty = self.level(*deeper, f"depth{depth}")
            parts.append(met)
            if light is None:
                break
            reached = [(light, weighty)]
        return self._union(parts)

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    def blocks(self, members: DataFrame) -> DataFrame:
        """``(node, block, u, comp, heavy)``: large nodes' main components are dealt to blocks, to all of which the rest goes."""
        columns = ["node", "block", "u", "comp", "heavy"]
        whole = members.where(F.col("size") <= SMALL).withColumn("block", F.lit(0)).select(*columns)
        large = members.where(F.col("size") > SMALL)
        if large.isEmpty():
            return whole
        counts = large.groupBy("node", "comp").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        main = counts.groupBy("node").agg(F.max_by("comp", F.struct("n", F.negative("comp"))).alias("main"), F.ceil(F.first("size") / SMALL).cast("int").alias("blocks"))
        dealt = large.select("node", "u", "comp", "heavy").join(main, "node")
        own = F.array(F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
        block = F.explode(F.when(F.col("comp") == F.col("main"), own).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return whole.unionByName(dealt.withColumn("block", block).select(*columns))

    def homes(self, members: DataFrame, classes: DataFrame, heavy: DataFrame | None) -> DataFrame:
        """``(home, u, comp, n, everywhere)``: the classes that nodes hold to be alike, once at each home."""
        sketches = classes.select("u", "n", "e0", "e1", "e2", "e3")
        rows = self.blocks(members)
        light = rows.where("NOT heavy").join(sketches, "u")
        if heavy is not None:
            light = light.unionByName(rows.where("heavy").select("*", F.lit(0).cast("bigint").alias("n"), *[F.lit(0).cast("bigint").alias(f"e{k}") for k in range(4)]))
        light = light.select("node", "block", "u", "comp", "heavy", "n", "e0", "e1", "e2", "e3")
        kind = "home bigint, u bigint, comp bigint, n bigint"
        found = light.repartition("node", "block").sortWithinPartitions("node", "block").mapInArrow(group_rows, kind + ", light boolean")
        found = found.groupBy("home", "u").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.first("light").alias("light"))
        if heavy is None:
            return found.select("home", "u", "comp", "n", (F.col("comp") != F.col("home")).alias("everywhere"))
        found = self.cut(found, "found")
        own = heavy.select("u", "comp", "n", "e0", "e1", "e2", "e3")
        told = found.where("NOT light").select("home", "u", "comp")
        guests = told.join(sketches, "u").unionByName(told.select("home", F.col("u").alias("comp")).join(own, "comp"))
        hosts = own.join(told.select(F.col("home").alias("comp")).distinct(), "comp").withColumn("home", F.col("comp"))
        held = guests.unionByName(hosts).withColumn("everywhere", F.col("comp") != F.col("home"))
        rows = self.dealt(held, F.lit(1), SKETCHES).select("home", "chunk", "u", "comp", "everywhere", "n", "e0", "e1", "e2", "e3")
        near = rows.repartition("home", "chunk").sortWithinPartitions("home", "chunk").mapInArrow(near_rows, kind).distinct()
        whole = found.where("light").select("home", "u", "comp", "n").unionByName(near)
        return whole.withColumn("everywhere", F.col("comp") != F.col("home"))

    def components(self, edges: DataFrame) -> DataFrame:
        """``(u, label)``, the least key reachable, for the ends of edges; doubling label propagation."""
        both = self.cut(edges.union(edges.select("b", "a")).toDF("u", "v"), "edges")
        labels = self.cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
        while True:
            near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
            lower = labels.join(near, "u").select("u", F.least("label", "near").alias("mid"), F.col("label").alias("was"))
            jump = labels.select(F.col("u").alias("mid"), F.col("label").alias("far"))
            new = lower.join(jump, "mid", "left").select("u", F.least("mid", "far").alias("label"), "was")
            new = self.cut(new, "labels")
            labels = new.select("u", "label")
            if new.where("label <> was").isEmpty():
                return labels

    def labels(self, classes: DataFrame) -> DataFrame | None:
        """Components ``(u, comp)`` of the classes that have links; None without links."""
        comps = self.contracted(classes)
        light, heavy = self.with_component(classes, comps), None
        if comps is not None:
            large = self.cut(comps.groupBy("comp").count().where(F.col("count") >= HEAVY).select("comp"), "heavy")
            if not large.isEmpty():
                large = self.sent(large)
                light, heavy = light.join(large, "comp", "left_anti"), light.join(large, "comp", "left_semi")
        links = self.compared(classes, self.homes(self.members(light, heavy), light, heavy))
        if not links.isEmpty():
            comps = self.cut(self.joined(comps, links), "comps", stays=True)
        self.release(0)
        return comps


def linked_rows(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, row, n_shingles, u, comp`` of each row; ``u`` and ``comp`` are null for empty sets."""
    run = _Join(docs, width)
    rows, classes = run.sketches()
    comps = run.labels(classes)
    if comps is None:
        return rows.withColumn("comp", F.col("u"))
    return rows.join(comps, "u", "left").select("doc_id", "row", "n_shingles", "u", F.coalesce("comp", "u").alias("comp"))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (``doc_id``, ``text``)."""
    rows = linked_rows(docs, width)
    least = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("found"))
    out = rows.join(least, "comp", "left")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("found"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one of the least id, once.

    A row with a null id stays only if its component has no named one.  Where an id is
    repeated, the row of the least hash of id and text stays.  Rows of empty sets stay, equal ones once.
    """
    rows = linked_rows(docs, width)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    key, own = first_free(docs.columns, "row"), first_free(docs.columns, "kept_row")
    first = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min_by("row", order).alias(own)).select(own)
    kept = first.unionByName(rows.where("comp IS NULL").select(F.col("row").alias(own))).distinct()
    found = docs.withColumn(key, row_key()).join(kept, F.col(key) == F.col(own), "left_semi")
    return found.dropDuplicates([key]).drop(key)
