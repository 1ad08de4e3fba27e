"""N-gram Jaccard join over prefix trees of globally ordered shingle sets.

Documents with the same set are one class, named by a hash of the set. All sets are put in one global order, frequent
shingles last. By the prefix bound, two sets that are similar enough share a shingle among the first
n - ceil(0.75 n) + 1 of each, so only these prefixes are dealt out, by shingle. Texts are read for classes and frequent
shingles, for prefixes, and for the sets of the classes that are compared, with hubs and then with others; these sets are
stored in order.

1. Where classes meet in a prefix shingle, the one whose prefix is most frequent is the shingle's hub. Members are joined
   with the hubs that they meet often, and the links found give first components: large groups of near copies mostly close
   here, in a number of comparisons that grows with their size, not with its square.
2. Classes that meet one hub most are a family. Those left outside the family's main component are joined with all of the
   family.
3. Other pairs in different components are candidates if they share as many prefix shingles as the bound on what remains
   of both asks, and the sizes allow the similarity.
4. Components of all links give each document the smallest id that it reaches.

Every join is made by prefix trees: a block of ordered sets is stored in one tree, and all the block's probes go down it
together. A node is visited once for all of them; sets below it share the overlap counted so far; a probe leaves where
what remains of it and of the longest set below can't reach the overlap asked for, or where none of its candidates is
below. Blocks of pairs are the cells of a grid of two hashes, so that neither a hub nor a member with many partners is
dealt to one task, and are as many as keep a cell at BLOCK_BYTES and BLOCK_PAIRS on average.

The order needs only be the same everywhere, so a bounded table of the most frequent shingles (HEAVY) is enough for it;
results don't depend on what the table holds. A shingle that the table knows to be very frequent is dealt to several
tasks, each with a hub of its own.

Broadcast: that table, and ids of classes where they were measured to be at most common.BROADCAST_IDS. What is written on
the way is deleted but for the result.

Defined results: null and empty texts have an empty set and stay alone; a text of fewer than SHINGLE words is one
shingle; repeated rows give repeated results; rows with a null doc_id link to nothing and have a null component; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import Steps, map_arrow, small, table, tasks_for
from .components import components

SHINGLE = 5
#: Similar means NUMERATOR / DENOMINATOR of the union at least.
NUMERATOR, DENOMINATOR = 3, 4
#: Most frequent shingles that go last, and those that each batch of documents names for it.
HEAVY = 1 << 18
HEAVY_OF_BATCH = 1 << 13
BUCKET_SHINGLES = 400_000
#: Sightings of a shingle, as the table counts them, that one task takes.
HOT_SHINGLE = 50_000
#: Bytes of the sets that meet in a task, and pairs, on average; and sets on either side of a block of a family.
BLOCK_BYTES = 8 << 20
BLOCK_PAIRS = 1024
FAMILY_BLOCK = 32
#: Tree nodes per set that are walked one by one; the rest of each path is one leaf, counted at once.
TREE_DEPTH = 24


def prefix_length(n):
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def asked_overlap(n, m):
    """The least intersection of similar sets of these sizes."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def _class(x: np.ndarray) -> int:
    """A hash of a set, as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = words.mix(x ^ words.PLACES[7]).sum(dtype=np.uint64) + np.uint64(len(x)) * words.PLACES[9]
    return int(words.mix(np.array([total], np.uint64)).view(np.int64)[0])


def _first_of_batch(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Class and set, sorted by value, of the documents of a batch, each class once, without empty sets."""
    seen = set()
    for _, found in words.chunks(batch.column("text"), words.NOT_SPACE):
        for x in words.shingle_sets(found, SHINGLE):
            if len(x) and (c := _class(x)) not in seen:
                seen.add(c)
                yield c, x


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, n and class of each row of docs (kind 0); frequent shingles of a batch (class) and how often they occur in
    it (n), of each class once (kind 1)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, ids: pa.Array, n, classes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), ids, pa.array(n, pa.int64()), pa.array(classes, pa.int64())], names=["kind", "doc_id", "n", "class"])

        for batch in batches:
            seen, every = set(), [np.empty(0, np.uint64)]
            for at, found in words.chunks(batch.column("text"), words.NOT_SPACE):
                n, classes = [], []
                for x in words.shingle_sets(found, SHINGLE):
                    n.append(len(x))
                    classes.append(_class(x) if len(x) else None)
                    if len(x) and classes[-1] not in seen:
                        seen.add(classes[-1])
                        every.append(x)
                yield rows(0, batch.column("doc_id").slice(at, len(found)), n, classes)
            shingles = np.concatenate(every)
            every.clear()
            shingles.sort()
            starts = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]])) if len(shingles) else np.empty(0, np.int64)
            counts = np.diff(np.append(starts, len(shingles)))
            often = np.flatnonzero(counts > 1)
            if len(often) > HEAVY_OF_BATCH:
                often = often[np.argpartition(counts[often], len(often) - HEAVY_OF_BATCH)[-HEAVY_OF_BATCH:]]
            yield rows(1, pa.nulls(len(often), batch.schema.field("doc_id").type), counts[often], shingles[starts[often]].view(np.int64))

    return map_arrow(docs.select("doc_id", "text"), run, f"kind int, doc_id {id_type}, n long, class long")


def _ordered_sets(docs: DataFrame, order) -> DataFrame:
    """class and its set in the global order, as bytes, once for each batch that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sets, size = [], [], 0
            for c, x in _first_of_batch(batch):
                classes.append(c)
                sets.append(order.value.sort(x)[0].tobytes())
                size += len(sets[-1])
                if size > words.CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], names=["class", "members"])
                    classes, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], names=["class", "members"])

    return map_arrow(docs.select("text"), run, "class long, members binary")


class _Order:
    """The global order: shingles outside the table of frequent ones by value, then that table by count and value."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        by = np.argsort(shingles)
        self.shingles, self.counts = shingles[by], counts[by]

    def count(self, x: np.ndarray) -> np.ndarray:
        """How often each shingle was counted; 0 outside the table."""
        if not len(self.shingles):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, x), len(self.shingles) - 1)
        return np.where(self.shingles[at] == x, self.counts[at], 0)

    def sort(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x, sorted by value, in the global order, and the counts."""
        counts = self.count(x)
        often = counts > 0
        if not often.any():
            return x, counts
        heavy, c = x[often], counts[often]
        by = np.lexsort((heavy, c))
        return np.concatenate([x[~often], heavy[by]]), np.concatenate([np.zeros(len(x) - len(heavy), np.int64), c[by]])


#: What a class's entry in a prefix shingle's list has.
ENTRY = np.dtype([("shingle", np.uint64), ("class", np.int64), ("n", np.int32), ("weight", np.float32)])


def _shared_prefixes(docs: DataFrame, order, n_buckets: int) -> DataFrame:
    """shingle, class, n, hub, hub_n: prefix shingles that classes share, with the hub of the task that they met in."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries, spread = [], []
            for c, x in _first_of_batch(batch):
                n, p = len(x), prefix_length(len(x))
                x, counts = order.value.sort(x)
                own = np.empty(p, ENTRY)
                own["shingle"], own["class"], own["n"], own["weight"] = x[:p], c, n, counts[:p].mean()
                entries.append(own)
                # A hot shingle has several lists; which one a class is in follows from its name.
                spread.append(c % (1 + counts[:p] // HOT_SHINGLE))
            if not entries:
                continue
            e = np.concatenate(entries)
            # Bits that don't decide the order, as small values fill the prefixes.
            bucket = ((words.mix(e["shingle"]) + np.concatenate(spread).astype(np.uint64) * words.PLACES[3]) % np.uint64(n_buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            e, bucket = e[by], bucket[by]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(cut[1:], len(e))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([e[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], names=["bucket", "entries"])

    def meet(group: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(x.as_py() for x in group["entries"]), ENTRY)
        e = e[np.lexsort((e["class"], e["weight"], e["shingle"]))]
        fresh = np.concatenate([[True], e["shingle"][1:] != e["shingle"][:-1]])
        once = fresh | np.concatenate([[True], e["class"][1:] != e["class"][:-1]])
        e, fresh = e[once], fresh[once]
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(e)))
        # The last of a list has the most weight. A part of a hot list goes on even if one class is alone there.
        hub = np.repeat(starts + sizes - 1, sizes)
        keep = (np.repeat(sizes, sizes) > 1) | (order.value.count(e["shingle"]) >= HOT_SHINGLE)
        return pa.table({"shingle": e["shingle"][keep].view(np.int64), "class": e["class"][keep], "n": e["n"][keep].astype(np.int64), "hub": e["class"][hub[keep]], "hub_n": e["n"][hub[keep]].astype(np.int64)})

    dealt = map_arrow(docs.select("text"), deal, "bucket int, entries binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "shingle long, class long, n long, hub long, hub_n long")


class _Tree:
    """Ordered sets in a prefix tree. A node: children by shingle, the largest and least size of the sets below it, which
    sets these are (mask), and the tails (number of the set, rest of its path) that end in it."""

    __slots__ = ("children", "least", "mask", "most", "tails")

    def __init__(self) -> None:
        self.children: dict[int, _Tree] = {}
        self.tails: list[tuple[int, np.ndarray]] = []
        self.most, self.least, self.mask = 0, 1 << 62, 0

    def add(self, number: int, members: np.ndarray) -> None:
        node, n, bit = self, len(members), 1 << number
        path = members[:TREE_DEPTH].tolist()
        for at in range(len(path) + 1):
            node.most, node.least, node.mask = max(node.most, n), min(node.least, n), node.mask | bit
            if at < len(path):
                node = node.children.setdefault(path[at], _Tree())
        node.tails.append((number, members[TREE_DEPTH:]))

    def shingles(self) -> set[int]:
        found, todo = set(), [self]
        while todo:
            node = todo.pop()
            found.update(node.children)
            todo += node.children.values()
        return found

    def similar(self, probes: list[np.ndarray], wanted: list[int]) -> Iterator[tuple[int, int]]:
        """(number of probe, number of set) of similar pairs; wanted: for each probe the mask of sets that it asks for."""
        sizes = [len(x) for x in probes]
        at_nodes = np.array(sorted(self.shingles()), np.uint64)
        places = []
        for x in probes:
            held = at_nodes[np.minimum(np.searchsorted(at_nodes, x), len(at_nodes) - 1)] == x if len(at_nodes) else np.zeros(len(x), bool)
            places.append({int(x[i]): i for i in np.flatnonzero(held).tolist()})
        by_value: list[np.ndarray | None] = [None] * len(probes)
        # Of each probe that is at a node: the overlap so far, and the place after the last shingle found.
        todo = [(self, 0, [(i, 0, 0) for i in range(len(probes)) if wanted[i] & self.mask])]
        while todo:
            node, depth, active = todo.pop()
            # What the smallest set below asks for is the least that any asks. Both sides are in one order, so what a
            # probe holds before its place is behind.
            active = [(i, shared, at) for i, shared, at in active if shared + min(sizes[i] - at, node.most - depth) >= asked_overlap(sizes[i], node.least)]
            if not active:
                continue
            for number, rest in node.tails:
                size = depth + len(rest)
                for i, shared, at in active:
                    if wanted[i] >> number & 1 and shared + min(sizes[i] - at, len(rest)) >= (asked := asked_overlap(sizes[i], size)):
                        if len(rest):
                            if by_value[i] is None:
                                by_value[i] = np.sort(probes[i])
                            found = np.minimum(np.searchsorted(by_value[i], rest), sizes[i] - 1)
                            shared += int((by_value[i][found] == rest).sum())
                        if shared >= asked:
                            yield i, number
            for s, child in node.children.items():
                below = []
                for i, shared, at in active:
                    if wanted[i] & child.mask:
                        held = places[i].get(s)
                        below.append((i, shared, at) if held is None else (i, shared + 1, held + 1))
                if below:
                    todo.append((child, depth + 1, below))


class _Join:
    """What the steps of one join share: stored tables, the documents and the order of their sets."""

    def __init__(self, steps: Steps, docs: DataFrame, order, tasks: int):
        self.steps, self.docs, self.order, self.tasks = steps, docs, order, tasks

    def sets(self, classes: DataFrame) -> DataFrame:
        """class and members, its ordered set, of each of classes (class, n), as a stored table."""
        wanted, found = self.steps.store(classes.groupBy("class").agg(F.first("n").alias("n")), self.tasks, rows=F.count(F.lit(1)), shingles=F.sum("n"))
        if not found["rows"]:  # then no text needs to be read
            return wanted.select("class", F.lit(None).cast("binary").alias("members"))
        sets = _ordered_sets(self.docs, self.order).join(small(wanted.select("class"), found["rows"]), "class", "left_semi")
        return self.steps.store(sets.dropDuplicates(["class"]), 12 + found["shingles"] * 8 // BLOCK_BYTES)[0]

    def pairs(self, pairs: DataFrame) -> tuple[DataFrame, dict]:
        """pairs (a, b; n and m are their sizes), stored, with their number and the bytes of their sets."""
        return self.steps.store(pairs, self.tasks, rows=F.count(F.lit(1)), bytes=F.sum((F.col("n") + F.col("m")) * 8))

    def links(self, pairs: DataFrame, found: dict, sets: DataFrame) -> DataFrame:
        """The pairs, as pairs() gives them, of classes that are similar, as a stored table of a and b."""
        if not found["rows"]:
            return pairs.select("a", "b")
        side = math.ceil(max(found["bytes"] / BLOCK_BYTES, found["rows"] / BLOCK_PAIRS) ** 0.5)
        block = F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b", F.lit(1)), F.lit(side))
        roles = F.array(F.struct(F.col("a").alias("class"), F.col("b").alias("partner")), F.struct(F.col("b").alias("class"), F.lit(None).cast("long").alias("partner")))
        placed = pairs.select(block.alias("block"), F.explode(roles).alias("x")).groupBy("block", "x.class")
        placed = placed.agg(F.collect_list("x.partner").alias("partners"), F.bool_or(F.col("x.partner").isNull()).alias("asked"))
        rows = placed.join(sets, "class")

        def run(group: pa.Table) -> pa.Table:
            tree, numbers, probes = _Tree(), {}, {}
            for c, partners, asked, members in zip(group["class"].to_pylist(), group["partners"].to_pylist(), group["asked"].to_pylist(), group["members"], strict=True):
                x = np.frombuffer(members.as_py(), np.uint64)
                if partners:
                    probes[c] = (x, partners)
                if asked:
                    numbers[c] = len(numbers)
                    tree.add(numbers[c], x)
            wanted = [sum(1 << numbers[b] for b in set(partners)) for _, partners in probes.values()]
            names, askers = list(numbers), list(probes)
            out = [(askers[i], names[k]) for i, k in tree.similar([x for x, _ in probes.values()], wanted)]
            return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

        return self.steps.store(rows.groupBy("block").applyInArrow(run, "a long, b long"), max(12, side * side))[0]

    def families(self, members: DataFrame) -> tuple[DataFrame, dict]:
        """The members of families that have classes outside their main component, and the number of blocks to compare."""
        counted = members.groupBy("family", "component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
        families = (
            counted.groupBy("family")
            .agg(F.max(F.struct("size", "component", "shingles")).alias("main"), F.sum("size").alias("size"), F.sum("shingles").alias("shingles"))
            .where(F.col("size") > F.col("main.size"))
        )
        blocks = lambda size, shingles: F.ceil(F.greatest(size / FAMILY_BLOCK, shingles * 8 / BLOCK_BYTES)).cast("int")
        families = families.select(
            "family", F.col("main.component").alias("main"), blocks(F.col("size"), F.col("shingles")).alias("n_blocks"),
            blocks(F.col("size") - F.col("main.size"), F.col("shingles") - F.col("main.shingles")).alias("n_asking"),
        )
        families, found = self.steps.store(families, self.tasks, n=F.count(F.lit(1)), cells=F.sum(F.col("n_blocks") * F.col("n_asking")))
        return members.join(small(families, found["n"]), "family"), found

    def family_links(self, members: DataFrame, found: dict, sets: DataFrame) -> DataFrame:
        """Components (a, b) of one family that are linked: those outside its main component against all of it.

        Both sides come in blocks, so a task holds two blocks however large a family is.
        """
        if not found["n"]:
            return members.select(F.col("component").alias("a"), F.col("component").alias("b"))
        rows = members.drop("n").join(sets, "class")
        own = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        asked = rows.select("family", own(F.col("n_blocks"), 1).alias("block"), every(F.col("n_asking")).alias("asking"), F.lit(False).alias("asks"), "component", "members")
        asking = rows.where("component <> main").select("family", every(F.col("n_blocks")).alias("block"), own(F.col("n_asking"), 2).alias("asking"), F.lit(True).alias("asks"), "component", "members")

        def run(group: pa.Table) -> pa.Table:
            tree, names, of_component, probes, held = _Tree(), [], {}, [], []
            for asks, component, members in zip(*(group[k].to_pylist() for k in ("asks", "component", "members")), strict=True):
                x = np.frombuffer(members, np.uint64)
                if asks:
                    probes.append(component)
                    held.append(x)
                else:
                    of_component[component] = of_component.get(component, 0) | 1 << len(names)
                    tree.add(len(names), x)
                    names.append(component)
            wanted = [tree.mask & ~of_component.get(component, 0) for component in probes]
            met = sorted({(probes[i], names[k]) for i, k in tree.similar(held, wanted)})
            return pa.table({"a": pa.array([x for x, _ in met], pa.int64()), "b": pa.array([x for _, x in met], pa.int64())})

        return self.steps.store(asked.unionByName(asking).groupBy("family", "block", "asking").applyInArrow(run, "a long, b long"), max(12, found["cells"]))[0]


def _crossing(shared: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b, n, m) of different families and components that share enough of their prefixes."""
    placed = shared.select("shingle", "class").join(members, "class")
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("family").alias("first"), F.max("family").alias("last")).where("lo <> hi and first <> last").select("shingle")
    placed = placed.join(mixed, "shingle")
    # No partner shares more than what is left of a prefix here.
    placed = placed.withColumn("left", F.count("*").over(Window.partitionBy("class")))
    x, y = placed.alias("x"), placed.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    behind = lambda n: F.ceil(n * NUMERATOR / DENOMINATOR) - 1
    enough = F.greatest(F.lit(1), F.ceil((n + m) * NUMERATOR / (NUMERATOR + DENOMINATOR)) - F.greatest(behind(n), behind(m)))
    meeting = x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("x.family") != F.col("y.family"))
        & ((n > m) | ((n == m) & (F.col("x.class") > F.col("y.class"))))
        & (m * DENOMINATOR >= n * NUMERATOR)
        & (F.least("x.left", "y.left") >= enough),
    )
    counted = meeting.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), n.alias("n"), m.alias("m"), enough.alias("enough")).groupBy("a", "b").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("enough").alias("enough"))
    return counted.where("times >= enough").select("a", "b", "n", "m")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row. doc_id may be of any type that has an order."""
    spark = docs.sparkSession
    steps, result = Steps(spark), Steps(spark)
    rows, found = steps.store(_documents(docs), n=F.count_if(F.col("kind") == 0), shingles=F.sum(F.when(F.col("kind") == 0, F.col("n"))))
    n_rows = found["n"]
    of_docs = rows.where("kind = 0").select("doc_id", "n", "class")
    heavy = rows.where("kind = 1").groupBy("class").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "class").limit(HEAVY).toPandas()
    order = spark.sparkContext.broadcast(_Order(heavy["class"].to_numpy(np.int64).view(np.uint64), heavy["n"].to_numpy(np.int64)))
    n_buckets = max(24, (found["shingles"] or 0) // 4 // BUCKET_SHINGLES)
    shared, found = steps.store(_shared_prefixes(docs, order, n_buckets), n_buckets, n=F.count(F.lit(1)))
    # No later table has more rows than this, but for pairs that step 3 counts.
    tasks = tasks_for(found["n"])
    made = _Join(steps, docs, order, tasks)
    behind = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) - 1
    to_hub, found = made.pairs(
        shared.where((F.col("class") != F.col("hub")) & (F.least("n", "hub_n") * DENOMINATOR >= F.greatest("n", "hub_n") * NUMERATOR))
        .groupBy(F.col("hub").alias("a"), F.col("class").alias("b"))
        .agg(F.count("*").alias("times"), F.first("hub_n").alias("n"), F.first("n").alias("m"), F.first(F.col("n") - behind).alias("p"))
        # A pair seldom met is left to the next steps.
        .where(F.col("times") * 4 >= F.col("p"))
    )
    sides = lambda pairs: pairs.select(F.explode(F.array(F.struct(F.col("a").alias("class"), "n"), F.struct(F.col("b").alias("class"), F.col("m").alias("n")))).alias("x")).select("x.*")
    first_links = made.links(to_hub, found, made.sets(sides(to_hub)))

    def top(hubs: DataFrame, name: str) -> DataFrame:
        """class and the hub that it meets most (rows of a and b), or the one that this hub meets most."""
        best = hubs.groupBy("b").agg(F.max(F.struct("times", "a")).alias("m")).select(F.col("b").alias("class"), F.col("m.a").alias("hub"))
        above = best.select(F.col("class").alias("hub"), F.col("hub").alias("above"))
        return best.join(above, "hub", "left").select("class", F.coalesce("above", "hub").alias(name))

    # A class's family follows the hubs that it meets, its first component those that it is linked with.
    members = shared.groupBy("class").agg(F.first("n").alias("n")).join(top(to_hub, "family"), "class", "left").join(top(to_hub.join(first_links, ["a", "b"]), "component"), "class", "left")
    members, _ = steps.store(members.select("class", "n", F.coalesce("family", "class").alias("family"), F.coalesce("component", "class").alias("component")), tasks)
    crossing, n_crossing = made.pairs(_crossing(shared, members))
    of_families, n_families = made.families(members)
    sets = made.sets(sides(crossing).unionByName(of_families.select("class", "n")))
    links = first_links.unionAll(made.links(crossing, n_crossing, sets))
    for side in ("a", "b"):
        links = links.join(members.select(F.col("class").alias(side), F.col("component").alias(f"of_{side}")), side)
    links = links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    groups = components(links.unionAll(made.family_links(of_families, n_families, sets)), steps, tasks).select(F.col("node").alias("first"), F.col("component").alias("last"))
    groups = members.select("class", F.col("component").alias("first")).join(groups, "first", "left").select("class", F.coalesce("last", "first").alias("component"))
    # From classes back to documents: the smallest id of each component, through the classes' smallest ids.
    smallest = of_docs.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("own"))
    grouped, found = steps.store(smallest.join(groups, "class", "left").withColumn("component", F.coalesce("component", "class")), tasks_for(n_rows), n=F.count(F.lit(1)))
    least = grouped.groupBy("component").agg(F.min("own").alias("component_id"))
    named, _ = steps.store(grouped.join(least, "component").select("class", "component_id"), tasks_for(found["n"]))
    # Both sides are read from storage, so Spark can split the rows of a class with many copies.
    out = of_docs.join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out, _ = result.store(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")), tasks_for(n_rows))
    steps.clear()
    order.destroy()
    return out


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
