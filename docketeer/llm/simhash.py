"""SimHash fingerprints, BK-trees over shards of them, and the components of the links found."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketeer.llm.common import discard, gathered, parts_of, save

BITS = 64


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words; a shorter text is one run, one without words has none."""
    found = (text or "").encode().lower().split()  # bytes: A-Z alone are lower-cased, and white space is ASCII's
    if not found:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    return np.fromiter((xxhash.xxh64_intdigest(run, 42) for run in runs), np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


class Sets:
    """Union-find over a shard."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class BKTree:
    """A node's children are keyed by their Hamming distance to it; subtrees of up to ``leaf`` codes are lists.

    A code is in the tree once, with all its items beside it, so equal codes add no depth. A node, and a code's items,
    remember a member of the component that all of it is in, as long as there is only one: a search from inside of that
    component has nothing to find there, so a large group of near copies costs no more than its links.
    """

    def __init__(self, sets: Sets, leaf: int = 1) -> None:
        self.sets, self.leaf = sets, leaf
        self.root: tuple | list = []
        self.items: dict[int, tuple[list[int], list]] = {}  # of each code, and a member of their component if it is one
        self.visited = self.pruned = 0  # nodes and lists that searches went into, and subtrees that the distance ruled out

    def _narrow(self, one: list, item: int) -> None:
        if one[0] is not None and self.sets.find(one[0]) != self.sets.find(item):
            one[0] = None

    def _divided(self, codes: list[int]) -> tuple:
        children: dict[int, tuple | list] = {}
        for c in codes[1:]:
            children.setdefault((c ^ codes[0]).bit_count(), []).append(c)
        ones = [self.items[c][1][0] for c in codes]
        whole = None not in ones and len({self.sets.find(i) for i in ones}) == 1
        return (codes[0], children, [ones[0] if whole else None])

    def add(self, code: int, item: int) -> None:
        new = code not in self.items
        held, one = self.items.setdefault(code, ([], [item]))
        held.append(item)
        self._narrow(one, item)
        node, siblings, at = self.root, None, 0
        while not isinstance(node, list):
            pivot, children, one = node
            self._narrow(one, item)
            if pivot == code:
                return
            siblings, at = children, (code ^ pivot).bit_count()
            node = children.setdefault(at, [])
        if new:
            node.append(code)
        if len(node) > self.leaf:
            if siblings is None:
                self.root = self._divided(node)
            else:
                siblings[at] = self._divided(node)

    def _equal(self, code: int, item: int) -> Iterator[int]:
        """A code's items that are not in the item's component when their turn comes."""
        find = self.sets.find
        held, one = self.items[code]
        for i in held:
            if one[0] is not None and find(one[0]) == find(item):
                return
            if find(i) != find(item):
                yield i

    def apart(self, code: int, radius: int, item: int) -> Iterator[int]:
        """What lies in the radius and is not in the item's component when its turn comes, near children first.

        Only edges that the triangle inequality allows are followed; joins between two results count at once.
        """
        find, todo = self.sets.find, [self.root]
        while todo:
            node = todo.pop()
            self.visited += 1
            if isinstance(node, list):
                for c in node:
                    if (c ^ code).bit_count() <= radius:
                        yield from self._equal(c, item)
                continue
            pivot, children, one = node
            if one[0] is not None and find(one[0]) == find(item):
                continue
            d = (pivot ^ code).bit_count()
            if d <= radius:
                yield from self._equal(pivot, item)
            near = [e for e in children if d - radius <= e <= d + radius]
            self.pruned += len(children) - len(near)
            near.sort(key=lambda e: -abs(e - d))
            todo += [children[e] for e in near]


def forest(codes: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect the shard as all its pairs within the radius would: one fewer than a component's members."""
    sets = Sets(len(codes))
    tree = BKTree(sets)
    for i, code in enumerate(codes):
        for j in tree.apart(code, radius, i):
            sets.join(i, j)
            yield i, j
        tree.add(code, i)


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first ``keys`` columns, which the input is sorted by; values with one row are skipped."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [c.to_numpy() for c in batch.columns[:keys]]
        new = reduce(np.logical_or, [v[1:] != v[:-1] for v in values])
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(bounds):
            if not held or a or last != tuple(v[0] for v in values):
                if sum(x.num_rows for x in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(v[-1] for v in values)
    if sum(x.num_rows for x in held) > 1:
        yield pa.Table.from_batches(held)


def hex16(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` (a signed long with its 64 bits) of every whole text; null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in parts_of(batches, 1):
            codes = np.array([simhash(shingles(t, words)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks(radius: int, used: int = 0, parts: int = BITS) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 blocks of the bits: codes within the radius agree on one of them at least."""
    edges = [used + parts * i // (radius + 1) for i in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def block_value(code: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit(mask))


def links(codes: DataFrame, radius: int = 2, shard: int = 256, most: int = 4096) -> DataFrame:
    """``a``, ``b``: links that connect the distinct codes (column ``fp``) as all pairs within the radius do.

    A pair within the radius agrees on one of radius + 1 blocks of bits, so also on the first bits of it. A shard holds the codes
    that agree on those, as many bits as give about ``shard`` codes each, and has a BK-tree. A shard of over ``most`` codes is
    divided by the blocks of its other bits: again a pair within the radius agrees on one of them, so no link is lost.
    """
    n = codes.count()
    width = min(BITS // (radius + 1), max(0, (n // shard).bit_length() - 1))
    first = [(shift, (1 << width) - 1) for shift, _ in blocks(radius)] if width else [(0, 0)]
    keyed = codes.select("fp", F.posexplode(F.array(*[block_value(F.col("fp"), *b) for b in first])).alias("block", "value"))
    large = keyed.groupBy("block", "value").count().where(F.col("count") > most).select("block", "value", F.lit(True).alias("large"))
    # the other bits of a shard, as one number: those before its block and those behind it
    others = F.element_at(F.array(*[rest_of(F.col("fp"), *b) for b in first]), F.col("block") + 1)
    finer = F.array(*[F.struct(F.lit(i).alias("i"), block_value(others, *b).alias("v")) for i, b in enumerate(blocks(radius, 0, BITS - width))])
    keyed = keyed.join(large, ["block", "value"], "left")
    keyed = keyed.select("block", "value", F.explode(F.when(F.col("large"), finer).otherwise(F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("v"))))).alias("f"), "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in runs(batches, 4):
            fp = held.column("fp").to_numpy()
            found = list(forest(fp.view(np.uint64).tolist(), radius))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(fp[[i for i, _ in found]]), pa.array(fp[[j for _, j in found]])], names=["a", "b"])

    flat = keyed.select("block", "value", F.col("f.i").alias("i"), F.col("f.v").alias("v"), "fp")
    dealt = flat.repartition("block", "value", "i", "v").sortWithinPartitions("block", "value", "i", "v", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def rest_of(code: Column, shift: int, mask: int) -> Column:
    """The bits outside a block, moved together."""
    below = code.bitwiseAND(F.lit((1 << shift) - 1))
    top = shift + mask.bit_length()
    above = F.shiftleft(F.shiftrightunsigned(code, top), shift) if top < BITS else F.lit(0).cast("long")
    return below.bitwiseOR(above)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of the links (``a``, ``b``) reaches.

    Every round a node takes the least root among its neighbours', and then that root's root; both are saved, so a lost
    executor costs one round at most. The rounds grow with the logarithm of the longest path in practice.
    """
    edges = save(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    # with the number of each node's links, so that those of a frequent one needn't be dealt to one task
    roots = save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"), F.count("*").alias("n")))
    n_edges, n_nodes = edges.count(), roots.count()
    while True:
        seen = looked_up(edges, roots.select(F.col("node").alias("b"), "root", "n"), "b", n_edges).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        near = roots.join(seen, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("before"), F.col("n").alias("degree"))
        near = save(gathered(near, n_nodes))
        far = near.select(F.col("node").alias("root"), F.col("root").alias("next")).join(near.groupBy("root").agg(F.count("*").alias("n")), "root")
        new = looked_up(near, far, "root", n_nodes).select("node", F.least("root", "next").alias("root"), "before", F.col("degree").alias("n"))
        new = save(gathered(new, n_nodes))
        changed = not new.where("root <> before").isEmpty()
        discard(near)
        discard(roots)
        roots = new.select("node", "root", "n")
        if not changed:
            discard(edges)
            return roots.select("node", "root")


def looked_up(rows: DataFrame, table: DataFrame, key: str | list[str], n_rows: int, most_hot: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``table``, which has each key once, and in ``n`` how many rows have it.

    Keys with over 1/``most_hot`` of the rows, fewer than ``most_hot``, are told apart by a list of their hashes in the plan; what the table has
    of them is broadcast, and their rows are not shuffled.
    """
    limit, name = n_rows // most_hot + 1, F.xxhash64(*([key] if isinstance(key, str) else key))
    hot = sorted({r.h for r in table.where(F.col("n") > limit).select(name.alias("h")).collect()})
    if not hot:
        return rows.join(table.drop("n"), key)
    some = name.isin(hot)
    few, many = table.where(some).drop("n"), table.where(~some).drop("n")
    return rows.where(some).join(F.broadcast(few), key).unionByName(rows.where(~some).join(many, key))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``: the least id that links reach.

    Fingerprints of ``words``-word shingles link at ``radius`` or fewer differing bits. Equal fingerprints are one node, so
    groups of copies never meet in pairs. Null and empty texts have fingerprint zero and link like any other. Repeated rows
    come out as often; rows with a null id have a null id and take no part in their component's least id. Other columns are left.
    """
    prints = save(fingerprints(docs, words, id_col, text_col))
    codes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(codes, radius))
    named = save(codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_code = looked_up(named.select("fp", "root", F.col("n").alias("n_rows")), least, "root", named.count())
    of_code = save(of_code.select("fp", "component_id", F.col("n_rows").alias("n")))
    discard(codes, roots, named)
    return looked_up(prints, of_code, "fp", prints.count()).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# ---- documents that share a given part of their shingles ----

ROUTES, TOGETHER = 24, 2  # routing keys of a document, and least hashes in each
EARLY = 3  # routing keys that are enough for nearly all members of a group
_draws = np.random.default_rng(42).integers(1, 2**63, (2, ROUTES * TOGETHER), dtype=np.uint64)
FACTORS, MASKS = _draws[0] * np.uint64(2) + np.uint64(1), _draws[1]


def routes(distinct: np.ndarray) -> list[int]:
    """Keys that a pair of similar shingle sets shares one of: pairs of least hashes."""
    if not len(distinct):
        return []
    least = np.array([((distinct ^ m) * f).min() for f, m in zip(FACTORS, MASKS)], np.uint64).reshape(ROUTES, TOGETHER)
    return [xxhash.xxh64_intdigest(bytes([i]) + row.tobytes()) - (1 << 63) for i, row in enumerate(least)]


def content(distinct: np.ndarray) -> bytes:
    """A name for a shingle set."""
    return xxhash.xxh3_128_digest(distinct.tobytes())


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``t1`` and ``t2`` (a name for the text), ``cid`` (one for its set of shingles), its ``size``, ``fp`` and ``keys``, without the sets themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in parts_of(batches, 1):
            rows = []
            for text in texts:
                distinct = np.unique(shingles(text, words))
                rows.append((content(distinct), len(distinct), simhash(distinct), routes(distinct)))
            cid, size, fp, keys = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), pa.array(cid, pa.binary()), pa.array(size, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "t1", "t2", "cid", "size", "fp", "keys"],
            )

    return docs.select("doc_id", "text", *text_name(F.col("text"))).mapInArrow(run, "doc_id long, t1 long, t2 long, cid binary, size long, fp long, keys array<long>")


def text_name(text: Column) -> list[Column]:
    """128 bits that stand for a text, null included."""
    return [F.xxhash64(text.isNull(), text).alias("t1"), F.xxhash64(F.lit(1), text.isNull(), text).alias("t2")]


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``cid`` and the sorted distinct shingle hashes ``held``, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in parts_of(batches, 1):
            sets = [np.unique(shingles(t, words)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([content(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cid", "held"])

    return docs.mapInArrow(run, "cid binary, held binary").dropDuplicates(["cid"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return float(len(b) == 0)
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def similar_in(codes: list[int], sets: list[np.ndarray], similarity: float, radius: int, known: list | None = None, asks: list[bool] | None = None) -> Iterator[tuple[int, int]]:
    """Links between a shard's sets of at least the similarity: a forest with the components of all of them.

    A BK-tree gives the earlier members within the radius that are not in the component yet; exact similarity decides.
    With ``known``, members of one known group are in a component already; with ``asks``, only those rows look for others.
    """
    groups = Sets(len(codes))
    first: dict = {}
    for i, k in enumerate(known or ()):
        groups.join(first.setdefault(k, i), i)
    tree = BKTree(groups, leaf=32)
    if asks:
        for i, code in enumerate(codes):
            if not asks[i]:
                tree.add(code, i)
    for i, code in enumerate(codes):
        if asks and not asks[i]:
            continue
        for j in tree.apart(code, radius, i):
            if jaccard(sets[i], sets[j]) >= similarity:
                groups.join(i, j)
                yield i, j
        if not asks:
            tree.add(code, i)


def compared(dealt: DataFrame, keys: list[str], sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``a``, ``b``: the links that ``similar_in`` finds among the rows (cid, fp, known, asks) of each value of the keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in runs(batches, len(keys)):
            cid, known, asks = (shard.column(c).to_pylist() for c in ("cid", "known", "asks"))
            codes = shard.column("fp").to_numpy().view(np.uint64).tolist()
            held = [np.frombuffer(x, np.uint64) for x in shard.column("held").to_pylist()]
            found = list(similar_in(codes, held, similarity, radius, known if any(known) else None, asks if any(asks) else None))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([cid[i] for i, _ in found], pa.binary()), pa.array([cid[j] for _, j in found], pa.binary())], names=["a", "b"])

    rows = dealt.join(sets, "cid").select(*keys, "cid", "fp", "known", "asks", "held")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "cid").mapInArrow(run, "a binary, b binary").distinct()


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 32, most: int = 1024, most_hashes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``doc_id`` and ``component_id``: the least id that links between similar texts reach. See ``similar_rows``."""
    return similar_rows(docs, words, similarity, radius, most, most_hashes, id_col, text_col).select("doc_id", "component_id")


def similar_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 32, most: int = 1024, most_hashes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``doc_id``, ``t1`` and ``t2`` (a name for its text), ``component_id`` (the least id that links between similar texts reach) and ``root``, which names the component.

    Texts link whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more. Equal sets are one
    node, so copies never meet in pairs, and texts without words are equal. A shard holds the distinct sets that share a routing key; its
    BK-tree follows edges within ``radius`` bits of the SimHash, and exact similarity decides. A pair at a similarity of 0.8
    shares none of the 24 keys with probability 2e-11, and differs in over 32 bits less often than one in 10^9; closer pairs fewer still.

    First the shards of three keys are compared, in parts of ``most`` sets and ``most_hashes`` shingles at most: that joins
    nearly all members of each group. Then, of all keys, those shards remain in which members of several components have not
    been compared. Their largest component needn't be compared with itself: the others are a query set, in blocks of ``most``,
    against all members in parts. So no task holds a whole hot key, and no pair is left out.
    Null texts count as empty; rows with a null id link like any other but take no part in the least id; repeated rows come out as
    often. Other columns are left.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = save(sketches(docs, words))
    nodes = save(rows.groupBy("cid").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    routed = nodes.select("cid", "least", "fp", "size", F.posexplode("keys").alias("route", "key"))
    shared = routed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("hashes")).where("n > 1")
    total = lambda members, hashes: F.greatest(F.lit(1), F.ceil(members / most), F.ceil(hashes / most_hashes)).cast("int")
    shared = save(shared.select("key", total(F.col("n"), F.col("hashes")).alias("parts"), "n"))
    routed = save(looked_up(routed, shared, "key", nodes.count() * ROUTES))
    wanted = routed.select(F.col("least").alias("doc_id")).distinct()
    # rows without an id have no other name here, so all of theirs are taken
    sets = save(shingle_sets(docs.join(wanted, "doc_id", "left_semi").union(docs.where("doc_id IS NULL")), words))

    # by key as well: what one key leaves apart in different parts, the next mixes anew and joins
    deal = lambda n: F.pmod(F.xxhash64("cid", "key"), n).cast("int")
    alone = {"known": F.lit(None).cast("binary"), "asks": F.lit(False)}
    early = routed.where(F.col("route") < EARLY).withColumns({"part": deal(F.col("parts"))} | alone)
    edges = save(compared(early, ["key", "part"], sets, similarity, radius))
    roots = components(edges).withColumnRenamed("node", "cid")

    left = routed.where((F.col("route") >= EARLY) | (F.col("parts") > 1)).drop("parts").join(roots, "cid", "left")
    left = save(left.select("key", "cid", "fp", "size", F.coalesce("root", "cid").alias("known")))
    ranked = left.groupBy("key", "known").agg(F.count("*").alias("members"), F.sum("size").alias("hashes"))
    several = ranked.groupBy("key").agg(F.sum("members").alias("n"), F.sum("hashes").alias("hashes"), F.max(F.struct("members", "hashes", "known")).alias("top"), F.count("*").alias("groups"))
    several = several.where("groups > 1").select(
        "key", "n", F.col("top.known").alias("top"), total(F.col("n"), F.col("hashes")).alias("parts"),
        total(F.col("n") - F.col("top.members"), F.col("hashes") - F.col("top.hashes")).alias("blocks"),
    )
    several = save(several)
    apart = save(looked_up(left, several, "key", left.count()))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = apart.select("key", every(F.col("blocks")).alias("block"), deal(F.col("parts")).alias("part"), "cid", "fp", "known", F.lit(False).alias("asks"))
    asks = apart.where("known <> top").select("key", deal(F.col("blocks")).alias("block"), every(F.col("parts")).alias("part"), "cid", "fp", "known", F.lit(True).alias("asks"))
    more = compared(held.union(asks), ["key", "block", "part"], sets, similarity, radius)
    early_roots, roots = roots, components(edges.union(more)).withColumnRenamed("node", "cid")
    discard(early_roots, edges, shared, several, left, apart, routed, sets)
    named = save(nodes.join(roots, "cid", "left").select("cid", "least", "n", F.coalesce("root", "cid").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_set = looked_up(named.select("cid", "root", F.col("n").alias("n_rows")), least, "root", named.count())
    of_set = save(of_set.select("cid", "root", "component_id", F.col("n_rows").alias("n")))
    discard(nodes, roots, named)
    return looked_up(rows.select("doc_id", "t1", "t2", "cid"), of_set, "cid", rows.count()).select("doc_id", "t1", "t2", "component_id", "root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row of each group of similar texts (see ``similar_rows``): that with the least id, of several that with the least name of its text.

    Rows without an id come after all others, so they stand for their group only if it has no id. Of rows with the same id and the same text one
    stays, whatever their other columns hold. Groups are reduced before they are shuffled, and so are repeated rows.
    """
    groups = save(similar_rows(docs, id_col=id_col, text_col=text_col, **options))
    name = F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")
    kept = groups.groupBy("root").agg(F.min(name).alias("k")).select("k.doc_id", "k.t1", "k.t2")
    copies = groups.groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("n"))
    stand = save(kept.alias("k").join(copies.alias("c"), F.expr("k.doc_id <=> c.doc_id AND k.t1 = c.t1 AND k.t2 = c.t2")).select(F.col("k.doc_id").alias("__id"), F.col("k.t1").alias("__t1"), F.col("k.t2").alias("__t2"), "n"))
    discard(groups)
    first, second = text_name(F.col(text_col))
    rows = docs.withColumns({"__1": first, "__2": second})
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__1") == F.col("__t1")) & (F.col("__2") == F.col("__t2"))
    single = rows.join(stand.where("n = 1"), same, "left_semi")
    repeated = rows.join(stand.where("n > 1"), same, "left_semi").dropDuplicates([id_col, "__1", "__2"])
    return single.unionByName(repeated).select(*docs.columns)
