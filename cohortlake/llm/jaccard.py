"""N-gram Jaccard join with prefix trees.

A document's set holds the hashes of its distinct 5-word shingles; equal sets are one class. Sets of similarity 3/4
share at least 3/4 of either one's tokens, so a class of which less is found in any other class links with nothing. This
is settled first: every token goes once to the partition of its hash (packed, and joined within a task before), which
tells each class which of its tokens live elsewhere too. Tokens of the few classes left that the same classes hold (a
passage that travels whole) become one element with their number as its weight. Elements get one global order, rare ones
first, and classes meet on their prefixes: the elements from which on at least 3/4 of the class is left.

Comparisons are walks through prefix trees. First every class goes to the cell of the most central class it meets; the
tree of a cell finds the links among its members. What still meets across components is found in two ways. Large
components are cut into leaves of at most ``members`` classes, and the classes of a smaller component walk the tree of
each leaf they meet. Classes of small components meet at the places of their elements: a place is one tree, whatever is
shared there, so the rows grow with the prefixes of the classes and not with the pairs that share something. A place of
m > ``members`` classes is cut into sqrt(m / members) blocks, block against block. No link between different components
is lost, and no group of copies, however large, is expanded into pairs.

Tokens and elements have 54 bits; classes are named by 64 bits of a cryptographic hash of the set.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.batches import chunks, mix64, shingles, words
from cohortlake.llm.components import components
from cohortlake.llm.work import Scratch

SIZE = 5
BITS = 54
#: Stands for "several classes of one task" where the token went no further with their names.
SEVERAL = np.int64(-(2**63))


def _runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its shingles) of each row, in order."""
    for i, j, raw, at in chunks(column):
        _, _, hashes, firsts = words(raw, at)
        runs = shingles(hashes, SIZE)
        for k in range(j - i):
            own = hashes[firsts[k] : firsts[k + 1]]
            if len(own) >= SIZE:
                yield i + k, runs[firsts[k] : firsts[k + 1] - SIZE + 1]
            elif len(own):  # the whole sequence as one, apart from any shingle
                h = np.array([len(own)], np.uint64)
                for x in own:
                    h = mix64(h * np.uint64(31) + x)
                yield i + k, h
            else:
                yield i + k, own


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, int | None]]:
    """(sorted tokens, name of the class or None if there are none) of each row."""
    for _, runs in _runs(column):
        tokens = np.unique(runs >> np.uint64(64 - BITS)).astype(np.int64)
        name = hashlib.blake2b(tokens.tobytes(), digest_size=8).digest() if len(tokens) else None
        yield tokens, int.from_bytes(name, "big", signed=True) if name else None


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n, node (the class; null if the set is empty), and all columns of ``docs`` beyond doc_id and text."""
    rest = [f for f in docs.schema if f.name not in ("doc_id", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, nodes = zip(*((len(tokens), node) for tokens, node in _sets(batch.column(1))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), *batch.columns[2:]], ["doc_id", "n", "node", *batch.schema.names[2:]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rest)
    return docs.select("doc_id", "text", *(f.name for f in rest)).mapInArrow(run, f"doc_id {kind}, n long, node long{more}")


def _packed(part: np.ndarray, node: np.ndarray, token: np.ndarray, width: int) -> pa.RecordBatch | None:
    """A row for each part: its nodes, the number of tokens of each, and ``width`` bytes a token."""
    if not len(part):
        return None
    order = np.lexsort((token, node, part))
    part, node, token = part[order], node[order], token[order]
    raw = np.ascontiguousarray(token.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width])
    heads = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (node[1:] != node[:-1])])
    sizes = np.diff(np.r_[heads, len(part)]).astype("<u4")
    first = np.flatnonzero(np.r_[True, np.diff(part[heads]) != 0])
    last = np.r_[first[1:], len(heads)]
    at = np.r_[heads, len(part)]
    names = node[heads].astype("<i8")
    columns = [
        pa.array(part[heads[first]], pa.int32()),
        pa.array([names[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
        pa.array([sizes[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
        pa.array([raw[at[a] : at[b]].tobytes() for a, b in zip(first, last)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "nodes", "sizes", "tokens"])


def _unpacked(table: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, token) of every entry."""
    column = lambda name: b"".join(table.column(table.schema.get_field_index(name)).to_pylist())
    raw = np.frombuffer(column("tokens"), np.uint8).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.repeat(np.frombuffer(column("nodes"), "<i8"), np.frombuffer(column("sizes"), "<u4")), full.view("<i8").ravel()


def _distinct(node: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries by token and node, each once."""
    order = np.lexsort((node, token))
    node, token = node[order], token[order]
    new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])] if len(node) else np.zeros(0, bool)
    return node[new], token[new]


def _lists(node: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
    """(node, tokens) of each node."""
    order = np.argsort(node, kind="stable")
    node, token = node[order], token[order]
    heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, np.int64)
    offsets = pa.array(np.r_[heads, len(node)].astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(node[heads], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(token, pa.int64()))], ["node", "tokens"])


def living_tokens(docs: DataFrame, total: int, buffer: int = 1 << 20, group: int = 1 << 23) -> DataFrame:
    """(node, tokens): for every class those of its tokens that another class has as well, in several rows of which two may
    hold the same token. ``total``: number of tokens of the corpus; a partition gets about ``group`` of them.

    A task reads ``buffer`` tokens at a time. A token that several of its classes hold is known to live: they keep it,
    and one entry without their names goes on to the token's partition, so that a token of all documents sends one
    entry for each buffer.
    """
    spark = docs.sparkSession
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group))
    bits = (parts - 1).bit_length()
    parts, width = 1 << bits, -(-(BITS - bits) // 8)

    def send(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = np.fromiter(sets, np.int64, len(sets))
        node = np.repeat(names, [len(s) for s in sets.values()])
        token = np.concatenate(list(sets.values()))
        order = np.argsort(token, kind="stable")
        node, token = node[order], token[order]
        heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        times = np.diff(np.r_[heads, len(token)])
        lives = np.repeat(times > 1, times)
        once = np.r_[token[~lives], token[heads[times > 1]]]
        owner = np.r_[node[~lives], np.full(int((times > 1).sum()), SEVERAL)]
        yield _packed((once & (parts - 1)).astype(np.int32), owner, once >> bits, width)
        yield _packed((parts + (node[lives] & (parts - 1))).astype(np.int32), node[lives], token[lives], 8)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = {}, 0
        for batch in batches:
            for tokens, node in _sets(batch.column(0)):
                if node is not None and node not in sets:
                    sets[node] = tokens
                    size += len(tokens)
                if size >= buffer:
                    yield from filter(None, send(sets))
                    sets, size = {}, 0
        if sets:
            yield from filter(None, send(sets))

    def meet(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = key[0].as_py()
        known, todo, size = (np.zeros(0, np.int64),) * 2, [], 0
        for table in tables:
            node, token = _unpacked(table, width if part < parts else 8)
            todo.append((node, token))
            size += len(node)
            if size > buffer:  # copies of a class come once for each task; they do not pile up
                known = _distinct(*(np.concatenate(x) for x in zip(known, *todo)))
                todo, size = [], 0
        node, token = _distinct(*(np.concatenate(x) for x in zip(known, *todo)))
        if part < parts:
            heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            times = np.diff(np.r_[heads, len(token)])
            lives = np.repeat((times > 1) | (node[heads] == SEVERAL), times) & (node != SEVERAL)  # SEVERAL is the least name
            node, token = node[lives], (token[lives] << bits) | part
        yield _lists(node, token)

    dealt = docs.select("text").mapInArrow(deal, "part int, nodes binary, sizes binary, tokens binary")
    return dealt.groupBy("part").applyInArrow(meet, "node long, tokens array<long>")


def survivors(docs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, n, tokens, weights): the classes that may link, with their shared elements in the global order: classes of
    frequency (four to a doubling) in the upper bits, then a hash of the classes that hold the element."""
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = living_tokens(docs, total).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    found = scratch.save(found.join(nodes.select("node", "n"), "node").filter("4 * size(tokens) >= 3 * n"))
    each = found.select("node", "n", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("holders")).filter("c > 1")
    often = F.shiftleft(F.least(F.floor(4 * F.log2("c")), F.lit(255)).cast("long"), BITS)
    counts = counts.select("token", often.bitwiseOR(F.shiftrightunsigned(F.xxhash64("holders", "c"), 64 - BITS)).alias("code"))
    # one exchange by node serves both groupings
    kept = each.join(counts, "token").repartition("node").groupBy("node", "code").agg(F.first("n").alias("n"), F.count(F.lit(1)).cast("int").alias("w"))
    kept = kept.groupBy("node").agg(F.first("n").alias("n"), F.sum("w").alias("living"), F.sort_array(F.collect_list(F.struct("code", "w"))).alias("s"))
    kept = scratch.save(kept.filter("4 * living >= 3 * n").select("node", "n", F.col("s.code").alias("tokens"), F.col("s.w").alias("weights")))
    scratch.free(found)
    return kept


class PrefixTree:
    """Sets of weighted elements in one global order; a node holds the elements its sets share beyond its parent. A set is
    given by its elements, their weights and its size, as tokens that no other set has may be left out."""

    def __init__(self, sets: list[np.ndarray], weights: list[np.ndarray], sizes: list[int]):
        self.sizes = sizes
        self.sums = [np.r_[0, np.cumsum(w)] for w in weights]
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * len(sets) + 1000))  # sets may each go on from the one before
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.root = self._node([(k, sets[k]) for k in order], 0)

    def _node(self, members: list, depth: int) -> tuple:
        (k, first), last = members[0], members[-1][1]
        most = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:most] != last[depth:most])
        end = depth + int(differ[0]) if len(differ) else most
        ended = [k for k, s in members if len(s) == end]
        rest = [m for m in members if len(m[1]) > end]
        below, i = [], 0
        while i < len(rest):
            j = i + 1
            while j < len(rest) and rest[j][1][end] == rest[i][1][end]:
                j += 1
            below.append(self._node(rest[i:j], end))
            i = j
        after = max(int(self.sums[m][-1] - self.sums[m][end]) for m, _ in members)
        return first[depth:end], np.diff(self.sums[k][depth : end + 1]), ended, below, after, min(self.sizes[m] for m, _ in members)

    def linked(self, own: np.ndarray, weights: np.ndarray, size: int) -> Iterator[int]:
        """Sets that have similarity 3/4 with ``own`` of ``size``: 7 * overlap >= 3 * (sum of sizes)."""
        n = len(own)
        if not n:
            return
        left = np.r_[np.cumsum(weights[::-1])[::-1], 0]
        todo = [(self.root, 0, 0)]
        while todo:
            (tokens, tree, ended, below, after, least), overlap, passed = todo.pop()
            if len(tokens):
                overlap += int(tree[own[np.minimum(np.searchsorted(own, tokens), n - 1)] == tokens].sum())
                passed = int(np.searchsorted(own, tokens[-1], "right"))
            yield from (k for k in ended if 7 * overlap >= 3 * (size + self.sizes[k]))
            if below and 7 * (overlap + min(after, int(left[passed]))) >= 3 * (size + least):
                todo += [(b, overlap, passed) for b in below]


def _arrays(table: pa.Table | pa.RecordBatch, name: str) -> list[np.ndarray]:
    lists = table[name]
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _read(table: pa.Table | pa.RecordBatch) -> tuple[list[int], list[np.ndarray], list[np.ndarray], list[int]]:
    return table["node"].to_pylist(), _arrays(table, "tokens"), _arrays(table, "weights"), table["n"].to_pylist()


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, token, at, pos, left) of each element of a prefix: its index, the weight before it and from it on."""
    for batch in batches:
        for node, tokens, weights, n in zip(*_read(batch)):
            ends = np.cumsum(weights.astype(np.int64))
            left = ends[-1] - ends + weights
            m = int(np.count_nonzero(4 * left >= 3 * n))
            columns = [np.full(m, node), np.full(m, n), tokens[:m], np.arange(m), (ends - weights)[:m], left[:m]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["node", "n", "token", "at", "pos", "left"])


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*found) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


class Forest:
    """Disjoint sets by name."""

    def __init__(self):
        self.group: dict[int, int] = {}

    def top(self, k: int) -> int:
        group = self.group
        while group.setdefault(k, k) != k:
            group[k] = k = group[group[k]]
        return k

    def join(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` were apart."""
        a, b = self.top(a), self.top(b)
        self.group[a] = b
        return a != b


def _cell(table: pa.Table) -> pa.Table:
    """A forest of the links among the members of a cell."""
    node, tokens, weights, sizes = _read(table)
    tree, forest, out = PrefixTree(tokens, weights, sizes), Forest(), []
    central = node.index(table["cell"][0].as_py())
    for k in [central, *(i for i in range(len(node)) if i != central)]:
        if k != central and forest.top(k) == forest.top(central):
            continue  # part of the central class's component: others come to it
        out += [(node[k], node[hit]) for hit in tree.linked(tokens[k], weights[k], sizes[k]) if forest.join(hit, k)]
    return _edges(out)


def _leaf(table: pa.Table) -> pa.Table:
    """A link of each class that comes to a leaf with one of its members, if there is any."""
    asks = np.asarray(table["asks"])
    if asks.all() or not asks.any():
        return _edges([])
    members, *sets = _read(table.filter(pa.array(~asks)))
    tree, out = PrefixTree(*sets), []
    for node, *own in zip(*_read(table.filter(pa.array(asks)))):
        hit = next(tree.linked(*own), None)
        if hit is not None:
            out.append((node, members[hit]))
    return _edges(out)


def _places(table: pa.Table) -> pa.Table:
    """A forest of the links between components at the places of a bucket. Sets begin with the element of the place, so a
    pair has its whole overlap at the first element it shares."""
    node, tokens, weights, sizes = _read(table)
    root = table["root"].to_pylist()
    place = np.stack([np.asarray(table[c]).astype(np.int64) for c in ("token", "one", "other", "block")])
    order = np.lexsort(place[::-1])
    ends = np.flatnonzero(np.r_[(np.diff(place[:3, order]) != 0).any(0), True]) + 1
    forest, out = Forest(), []
    for here in np.split(order, ends[:-1]):
        _, one, other, _ = place[:, here[0]]
        block = place[3, here]
        members, walkers = here[block == one], here[block == other]
        if len({root[k] for k in here}) < 2 or not len(members) or not len(walkers):
            continue
        tree = PrefixTree([tokens[k] for k in members], [weights[k] for k in members], [sizes[k] for k in members])
        for k in walkers:
            hits = (members[h] for h in tree.linked(tokens[k], weights[k], sizes[k]))
            out += [(node[k], node[h]) for h in hits if root[h] != root[k] and forest.join(root[h], root[k])]
    return _edges(out)


def in_cells(kept: DataFrame, entries: DataFrame, scratch: Scratch, members: int) -> DataFrame:
    """Links (a, b) of classes within the cell of the most central class they meet."""
    counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = scratch.save(entries.select("token", "node").join(counts, "token"))
    weight = met.groupBy("node").agg(F.sum("c").alias("weight"))
    # an original meets others on more tokens than its copies do
    central = met.join(weight, "node").groupBy("token").agg(F.max(F.struct("weight", "node"))["node"].alias("cell"))
    choice = met.join(central, "token").groupBy("node", "cell").agg(F.count(F.lit(1)).alias("times"))
    choice = choice.groupBy("node").agg(F.max(F.struct((F.col("cell") != F.col("node")).alias("other"), "times", "cell"))["cell"].alias("cell"))
    choice = scratch.save(choice.filter("cell <> node"))
    deal = choice.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / members).cast("int").alias("parts"))
    own = choice.join(deal, "cell").select("node", "cell", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    heads = deal.select(F.col("cell").alias("node"), "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    links = scratch.save(own.union(heads).join(kept, "node").groupBy("cell", "part").applyInArrow(_cell, "a long, b long"))
    scratch.free(met, choice)
    return links


def in_places(kept: DataFrame, met: DataFrame, scratch: Scratch, members: int) -> DataFrame:
    """Links (a, b) between components of ``met`` (node, root, n, token, at, left), found where elements are shared. Only
    for components of a bounded number of classes, as all of them come to a place."""
    for _ in range(2):  # who finds nobody to link with leaves; then others do
        there = met.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least"), F.max("left").alias("most"))
        fits = 7 * F.least("left", "most") >= 3 * (F.col("n") + F.col("least"))
        met = met.join(there.filter("lo < hi").drop("lo", "hi"), "token").filter(fits).drop("least", "most")
    met = scratch.save(met)
    there = met.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi")
    come = met.join(there.select("token", F.ceil(F.sqrt(F.col("m") / members)).cast("int").alias("blocks")), "token")
    come = come.select("token", "node", "root", "at", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    come = come.join(kept, "node").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = [F.slice(c, F.col("at") + 1, F.size(c)).alias(c) for c in ("tokens", "weights")]
    come = scratch.save(come.select("token", F.least("block", "to").alias("one"), F.greatest("block", "to").alias("other"), "block", "root", "node", "n", *cut))
    buckets = int((come.agg(F.sum(F.size("tokens"))).first()[0] or 0) >> 18) + 1
    links = come.groupBy(F.pmod(F.xxhash64("token", "one", "other"), F.lit(buckets)).alias("bucket")).applyInArrow(_places, "a long, b long")
    links = scratch.save(links)
    scratch.free(met, come)
    return links


def across(kept: DataFrame, entries: DataFrame, roots: DataFrame, scratch: Scratch, members: int, few: int = 32) -> DataFrame:
    """Links (a, b) between the components ``roots`` (node, root). Components of more than ``few`` classes are cut into
    leaves; the others meet at the places of their elements."""
    entries = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    contested = entries.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
    met = scratch.save(entries.join(contested, "token"))
    large = met.select("root", "node").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > few)
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))  # a large component is no one task's
    met = met.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(16)).cast("int")).join(large, ["root", "salt"], "left").drop("salt")
    met = scratch.save(met.withColumn("rank", F.struct(F.coalesce("m", F.lit(0)).alias("m"), "root")).drop("m"))
    small = in_places(kept, met.filter("rank.m = 0").drop("rank", "pos"), scratch, members)
    big = met.filter("rank.m > 0").withColumn("leaf", F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("rank.m") / members)).cast("int"))
    leaves = big.groupBy("token", "rank", "leaf").agg(F.min("n").alias("least"), F.max("pos").alias("before"), F.max("left").alias("after"))
    leaves = leaves.select("token", F.col("rank").alias("theirs"), F.col("leaf").alias("into"), "least", "before", "after")
    fits = (F.col("rank") < F.col("theirs")) & (7 * (F.least("pos", "before") + F.least("left", "after")) >= 3 * (F.col("n") + F.col("least")))
    asks = met.join(leaves, "token").filter(fits).select("node", F.col("theirs.root").alias("root"), F.col("into").alias("leaf")).distinct()
    asks = scratch.save(asks)
    deal = asks.groupBy("root", "leaf").agg(F.ceil(F.count(F.lit(1)) / members).cast("int").alias("parts"))
    come = asks.join(deal, ["root", "leaf"]).select("node", "root", "leaf", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("asks"))
    there = big.select("node", "root", "leaf").distinct().join(deal, ["root", "leaf"])
    there = there.select("node", "root", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"))
    return scratch.save(small.union(come.union(there).join(kept, "node").groupBy("root", "leaf", "part").applyInArrow(_leaf, "a long, b long")))


def grouped(docs: DataFrame, mark: F.Column, scratch: Scratch, members: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``docs`` as ``described``; (node, root) of each class; and (root, component) of each component, with the
    least ``mark`` of its rows."""
    rows = scratch.save(described(docs))
    nodes = scratch.save(rows.filter("n > 0").groupBy("node").agg(F.min(mark).alias("least"), F.first("n").alias("n")))
    kept = survivors(docs, nodes, scratch)
    entries = scratch.save(kept.mapInArrow(_prefixes, "node long, n long, token long, at long, pos long, left long"))
    links = in_cells(kept, entries, scratch, members)
    roots = components(links, scratch)
    more = across(kept, entries, roots, scratch, members)
    if not more.isEmpty():
        roots = components(links.union(more), scratch)
    named = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return rows, named.select("node", "root"), named.groupBy("root").agg(F.min("least").alias("component"))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Null, empty and all-blank texts have 0 shingles and are alone; very long texts are read whole. Repeated rows share a class. A null doc_id gets the
    least id of its component, or null if there is none. An empty table gives no rows. Other columns are not read.
    """
    rows, named, ids = grouped(docs.select("doc_id", "text"), F.col("doc_id"), Scratch(docs.sparkSession))
    named = named.join(ids, "root").select("node", "component")
    out = rows.select("doc_id", "n", "node").join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: the least by doc_id, nulls last, and then by a hash of the text.

    A row is known by a hash of id and text, so that neither a null id nor one with several texts stands for another
    row. Null, empty and all-blank texts are alone: each stays, except that a repeated row with an id stays once. Very long
    texts are read whole; an empty table gives no rows; other columns stay as they are, whatever their names.
    """
    scratch, own = Scratch(docs.sparkSession), "_row"
    while own in docs.columns:
        own += "_"
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull().cast("string"), F.coalesce("text", F.lit("")), F.col("text").isNull().cast("string")))
    docs_ = docs.withColumn(own, key)
    mark = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(own).alias("row"))
    rows, _, ids = grouped(docs_.select("doc_id", "text", own), mark, scratch)
    kept = scratch.save(ids.select(F.col("component.row").alias(own)).union(rows.filter("n = 0").select(own)).distinct())
    # nothing tells rows without id and words apart
    bare = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return docs_.filter(~bare).join(kept, own, "left_semi").dropDuplicates([own]).drop(own).union(docs.filter(bare))
