"""Jaccard join of documents on word n-grams by prefix trees.

A document's set is that of its distinct n-word shingles, as 64-bit digests. Documents with equal sets are one
class; classes whose sets meet 100 * intersection >= percent * union are linked, and the result says which
documents are connected. No pair is lost, and no pairs are listed:

1. Routing. Linked sets of at most u shingles differ in at most K = 2u(100 - percent)/(100 + percent) of them. Shingles
   are dealt to K + R parts by their digests; linked sets then agree in R parts at least, or R less the empty ones of a set
   if only parts that aren't empty count. A set names its parts, and two sets can only be linked if they share that many names;
   texts that merely share a passage, a line or frequent words share few. Sizes are cut into ranges so that both sides
   use the same K. Names go to buckets as packed blocks, some seven bytes each. Sets of a name of at most ``CROWD`` sets are
   paired and their shared names counted. A name of more sets is crowded: sets that have enough crowded names for a
   link are tied to a knot, a node that stands for the name, and such names count for any pair of others. So no pair is
   lost, and none is listed for a crowd. Names that crowd a block already move once for the block.
2. Clusters are the connected components of these pairs and ties; they hold little but true near copies. Only their
   texts move, one for each class, found by a bounded filter of digests and then by the digests themselves.
3. Join. The sets of a cluster, in one order of shingles (those that most of its sets have first), are stored in a
   trie; each set walks it once, overlaps of shared beginnings are counted once, and a subtree is left as soon as
   the lengths that remain on both sides can't reach the threshold. A leaf's overlap is exact.
   A cluster of more than ``BLOCK`` sets is dealt to blocks by digest, and each block is joined together with the
   ``HUBS`` sets that agree with most others; sets which that leaves outside the cluster's largest component
   then meet others again: those that share one of their rarest shingles in the cluster, a few of which any linked set has
   too, or, where these are so common that this would be more work, every block, in blocks of their own. Sets in one
   component need not meet again.

Defined cases: A-Z are lowered, words are runs of other characters than white space; a text of fewer words than n has
its whole sequence as its one shingle; null, empty and blank texts have an empty set, no link and their own
id as component; repeated rows, and rows with equal ids, each get a row; null ids take part, and a component of
null ids alone has a null id; very long texts count whole; extra columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import written
from heronlake.llm.graph import Filter, components, salted_join

N = 3
PERCENT = 90
BLOCK = 512
HUBS = 8
#: Names of a bucket, about.
BUCKET = 1_000_000
#: Sets that are paired by a name they share, at most.
CROWD = 8
_KEPT = 300_000


class _WordDigests(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _KEPT:
            self.clear()
        self[word] = h
        return h


_digests = _WordDigests()


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, n: int = N):
    """Sorted distinct digests of a text's shingles, as unsigned 64-bit numbers."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_digests.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(words))
    x = np.full(len(words) - width + 1, 0x9E3779B97F4A7C15 * (width + 1) & (2**64 - 1), dtype=np.uint64)
    for k in range(width):
        x = _mixed(x * np.uint64(0xC2B2AE3D27D4EB4F) + w[k : len(words) - width + 1 + k])
    return np.unique(x)


class Ranges:
    """Ranges of set sizes with the number of parts for each."""

    def __init__(self, percent: int):
        self.percent = percent
        #: The least size with a partner other than an equal set.
        self.least = next((s for s in range(1, 10_000) if 100 * s // percent > s), 10_000)

    def of(self, size: int) -> list[tuple[int, int, int]]:
        """(number, differing parts at most, parts) of the range of ``size``, and of the next if partners reach it."""
        if size < self.least:
            return []
        out, low, k = [], self.least, 0
        while True:
            above = max(low + 1, low * 5 // 4)
            if low <= size < above or (size < low <= 100 * size // self.percent):
                most = 2 * (above - 1) * (100 - self.percent) // (100 + self.percent)
                out.append((k, most, most + 3 + most * 2 // 5))
            if low > 100 * size // self.percent:
                return out
            low, k = above, k + 1


def signatures(x, ranges: Ranges):
    """Digests of the parts of a set, for each of its size ranges, and how many of them a linked set shares at least."""
    import numpy as np

    out, need = [], 1 << 15
    for number, differing, parts in ranges.of(len(x)):
        part = ((x >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        total = np.zeros(parts, dtype=np.uint64)
        np.add.at(total, part, _mixed(x ^ np.uint64(0xD6E8FEB86659FD93)))
        full = np.bincount(part, minlength=parts) > 0
        named = _mixed(_mixed(total + np.arange(parts, dtype=np.uint64)) + np.uint64(number * 0x165667B19E3779F9 & (2**64 - 1)))
        shared = int(full.sum()) - differing
        out.append(named[full] if shared > 0 else named)  # with many empty parts these count too
        need = min(need, shared if shared > 0 else parts - differing)
    return (np.concatenate(out) if out else np.empty(0, dtype=np.uint64)), need


def _slices(batch, at: int) -> Iterator:
    """Parts of a batch of some megabytes of text in its column ``at``, unless one text alone is longer."""
    import pyarrow.compute as pc

    start = total = 0
    for i, size in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
        if i > start and (i - start == 1024 or total + (size or 0) > 1 << 23):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _digest(x) -> int | None:
    """A set's digest as a signed, even number; none for the empty set."""
    import xxhash

    return (xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63) & ~1 if len(x) else None


def described(df: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), digest of the text."""
    df = df.select("doc_id", "text", F.xxhash64("text").alias("h"))
    schema = T.StructType([df.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("d", T.LongType()), T.StructField("h", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch, 1):
                sizes, digests = [], []
                for t in part.column(1):
                    x = shingle_set(t.as_py(), n)
                    sizes.append(len(x))
                    digests.append(_digest(x))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), part.column(2)], names=schema.names)

    return df.mapInArrow(run, schema)


def _least_labels(i, j, size: int):
    """For each of ``size`` nodes the least node connected to it by edges (i, j)."""
    import numpy as np

    label = np.arange(size)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


PAIR, TIE, KNOT = 0, 1, 2
_MANY = 1 << 20


def _knots(names):
    """Nodes that stand for names: odd numbers, as those of sets are even."""
    import numpy as np

    return (_mixed(names).view(np.int64)) | 1


def _ties(who, names, digests, needs):
    """Rows (a, b, n, need, kind) that tie sets (places ``who``) to the knots of crowded names they have. Sets with enough of
    them for a link get one tie, to the least knot of those that such sets connect; others one for each."""
    import numpy as np

    if not len(who):
        return np.empty((0, 5), dtype=np.int64)
    have = np.bincount(who, minlength=len(digests))
    sure = (have >= needs)[who]
    out = []
    w, k = who[~sure], names[~sure]
    out.append(np.stack([digests[w], _knots(k), np.ones(len(w), dtype=np.int64), needs[w], np.full(len(w), TIE)], 1))
    if sure.any():
        knots, place = np.unique(names[sure], return_inverse=True)
        sets, own = np.unique(who[sure], return_inverse=True)
        label = _least_labels(own + len(knots), place, len(knots) + len(sets))
        ids = _knots(knots)
        out.append(np.stack([digests[sets], ids[label[len(knots) :]], np.full(len(sets), _MANY), needs[sets], np.full(len(sets), TIE)], 1))
        moved = label[: len(knots)] != np.arange(len(knots))
        zero = np.zeros(moved.sum(), dtype=np.int64)
        out.append(np.stack([ids[moved], ids[label[: len(knots)][moved]], zero, zero, zero + KNOT], 1))
    return np.concatenate(out)


def _blocks(ds: list[int], needs: list[int], names: list, buckets: int):
    """Rows (bucket, names, who, ds, needs) for sets with digests ``ds`` that name ``names``: 39 bits of each name and whether it
    is crowded here, places in ds, and ds; and one row (who is null) of ties made here."""
    import numpy as np

    digests, need = np.array(ds, dtype=np.int64), np.array(needs, dtype=np.int64)
    who = np.repeat(np.arange(len(ds)), [len(x) for x in names])
    flat = np.concatenate(names)
    # a name is its bucket and 39 bits, here and there
    bucket = ((flat >> np.uint64(39)) % np.uint64(buckets)).astype(np.int64)
    flat = (flat & np.uint64((1 << 39) - 1)) | (bucket.astype(np.uint64) << np.uint64(39))
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    sizes = np.diff(np.append(starts, len(flat)))
    crowded = np.repeat(sizes > CROWD, sizes)
    ties = _ties(who[crowded], flat[crowded], digests, need)
    if len(ties):
        yield int(bucket[0]), None, None, ties.tobytes(), None
    keep = ~crowded
    keep[starts] = True  # of a crowded name one set goes on, so that it is known to be crowded
    flat, who, crowded = flat[keep], who[keep], crowded[keep]
    bucket = (flat >> np.uint64(39)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for a, b in zip(starts, np.append(starts[1:], len(flat))):
        own, place = np.unique(who[a:b], return_inverse=True)
        x = (flat[a:b] & np.uint64((1 << 39) - 1)) | (crowded[a:b].astype(np.uint64) << np.uint64(39))
        packed = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        yield int(bucket[a]), packed.tobytes(), place.astype("<u2").tobytes(), digests[own].tobytes(), need[own].astype("<u2").tobytes()


def _pairs(who, starts, sizes, digests, needs):
    """Rows (a, b, n, need, kind) of the pairs of sets that have equal names, n how many; names stand in a row, sorted."""
    import numpy as np

    out = []
    for size in range(2, CROWD + 1):
        at = starts[sizes == size]
        if not len(at):
            continue
        group = np.sort(who[at[:, None] + np.arange(size)], axis=1)
        i, j = np.triu_indices(size, 1)
        out.append(np.stack([group[:, i].ravel(), group[:, j].ravel()], 1))
    if not out:
        return np.empty((0, 5), dtype=np.int64)
    both = np.concatenate(out)
    both = both[both[:, 0] != both[:, 1]]
    code, n = np.unique(both[:, 0] * len(digests) + both[:, 1], return_counts=True)
    a, b = code // len(digests), code % len(digests)
    return np.stack([digests[a], digests[b], n, np.maximum(needs[a], needs[b]), np.full(len(a), PAIR)], 1)


def agreeing(docs: DataFrame, n: int, percent: int, buckets: int, at_once: int = 1_000_000) -> DataFrame:
    """Rows (a, b, n, need, kind): pairs of sets and how many names that aren't crowded they share in a bucket, ties of sets
    to knots, and knots that are one."""

    def dealt(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ranges, ds, needs, names, total, seen = Ranges(percent), [], [], [], 0, set()

        def out():
            rows = list(_blocks(ds, needs, names, buckets))
            kinds = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["bucket", "names", "who", "ds", "needs"])

        for batch in batches:
            for t in batch.column(0):
                x = shingle_set(t.as_py(), n)
                d = _digest(x)
                if d is None or d in seen:
                    continue  # copies name the same parts
                if len(seen) >= _KEPT:
                    seen.clear()
                seen.add(d)
                found, need = signatures(x, ranges)
                if len(ds) == 1 << 16 or (total and total + len(found) > at_once):
                    yield out()
                    ds, needs, names, total = [], [], [], 0
                if len(found):
                    ds.append(d)
                    needs.append(need)
                    names.append(found)
                    total += len(found)
        if ds:
            yield out()

    def met(key, table):
        import numpy as np
        import pyarrow as pa

        names, whos, digests, needs, rows, at = [], [], [], [], [], 0
        for packed, who, ds, need in zip(*(table.column(c).to_pylist() for c in ("names", "who", "ds", "needs"))):
            if who is None:
                rows.append(np.frombuffer(ds, dtype=np.int64).reshape(-1, 5))
                continue
            x = np.zeros((len(packed) // 5, 8), dtype=np.uint8)
            x[:, :5] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 5)
            names.append(x.view("<u8").ravel())
            whos.append(np.frombuffer(who, dtype="<u2").astype(np.int64) + at)
            digests.append(np.frombuffer(ds, dtype=np.int64))
            needs.append(np.frombuffer(need, dtype="<u2").astype(np.int64))
            at += len(digests[-1])
        if names:
            name, who = np.concatenate(names), np.concatenate(whos)
            classes, first, place = np.unique(np.concatenate(digests), return_index=True, return_inverse=True)  # a class may come in several blocks
            need, who = np.concatenate(needs)[first], place[who]
            crowded = name >> np.uint64(39) == 1
            name = name & np.uint64((1 << 39) - 1)
            order = np.lexsort((who, name))
            name, who, crowded = name[order], who[order], crowded[order]
            new = np.append(True, name[1:] != name[:-1])
            starts = np.flatnonzero(new)
            crowded = np.logical_or.reduceat(crowded, starts)
            once = new | np.append(True, who[1:] != who[:-1])
            group = (np.cumsum(new) - 1)[once]
            name, who = name[once], who[once]
            sizes = np.bincount(group, minlength=len(starts))
            crowded |= sizes > CROWD
            starts = np.cumsum(sizes) - sizes
            here = crowded[group]
            full = name | (np.uint64(key[0].as_py()) << np.uint64(39))
            rows.append(_ties(who[here], full[here], classes, need))
            rows.append(_pairs(who, starts[~crowded], sizes[~crowded], classes, need))
        found = np.concatenate(rows) if rows else np.empty((0, 5), dtype=np.int64)
        return pa.table({c: pa.array(found[:, i], pa.int64()) for i, c in enumerate(("a", "b", "n", "need", "kind"))})

    blocks = docs.select("text").mapInArrow(dealt, "bucket int, names binary, who binary, ds binary, needs binary")
    return blocks.groupBy("bucket").applyInArrow(met, "a long, b long, n long, need long, kind long")


def candidates(named: DataFrame) -> DataFrame:
    """Edges (a, b, n) of ``agreeing`` rows that may connect linked sets."""
    ties = named.where(F.col("kind") == TIE)
    crowd = written(ties.groupBy("a").agg(F.sum("n").alias("hot"), F.max("need").alias("least")), "join-crowd")
    tied = ties.join(crowd, "a").where("hot >= least").select("a", "b", "n")
    pairs = named.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    pairs = pairs.join(crowd.select("a", F.col("hot").alias("ha")), "a", "left").join(crowd.select(F.col("a").alias("b"), F.col("hot").alias("hb")), "b", "left")
    pairs = pairs.where("n + least(coalesce(ha, 0), coalesce(hb, 0)) >= need").select("a", "b", "n")
    return tied.unionByName(pairs).unionByName(named.where(F.col("kind") == KNOT).select("a", "b", "n"))


class _Node:
    __slots__ = ("tokens", "kids", "sets", "low", "high")

    def __init__(self, tokens):
        self.tokens, self.kids, self.sets, self.low, self.high = tokens, {}, [], 1 << 60, 0


class PrefixTree:
    """A trie of ordered sets (arrays of ascending numbers) whose chains of single children are one node."""

    def __init__(self):
        import numpy as np

        self.np, self.root = np, _Node(np.empty(0, dtype=np.int64))

    def add(self, tokens, name: int) -> None:
        np, node, at, size = self.np, self.root, 0, len(tokens)
        node.low, node.high = min(node.low, size), max(node.high, size)
        while at < size:
            kid = node.kids.get(first := int(tokens[at]))
            if kid is None:
                kid = node.kids[first] = _Node(tokens[at:])
                kid.low = kid.high = size
                kid.sets.append(name)
                return
            own = kid.tokens
            m = min(len(own), size - at)
            differ = np.flatnonzero(own[:m] != tokens[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(own):  # the node is cut where the new set leaves it
                top = _Node(own[:same])
                top.low, top.high = kid.low, kid.high
                kid.tokens = own[same:]
                top.kids[int(kid.tokens[0])] = kid
                node.kids[first] = kid = top
            node, at = kid, at + same
            node.low, node.high = min(node.low, size), max(node.high, size)
        node.sets.append(name)

    def meets(self, tokens, has, percent: int, wanted):
        """Names of stored sets that meet ``percent`` with ``tokens``; ``has`` is tokens as a mask. ``wanted`` says whether a
        name is still of interest."""
        np, size, out = self.np, len(tokens), []
        stack = [(kid, 0, 0) for kid in self.root.kids.values()]
        while stack:
            node, depth, overlap = stack.pop()
            overlap += int(has[node.tokens].sum())
            depth += len(node.tokens)
            # what is left: of this set the numbers behind the path's last, of a stored one its length without the path
            rest = size - int(np.searchsorted(tokens, node.tokens[-1], side="right"))
            most = overlap + min(rest, node.high - depth)
            if 100 * most < percent * (size + max(node.low, most) - most):
                continue
            for name in node.sets:
                if 100 * overlap >= percent * (size + depth - overlap) and wanted(name):
                    out.append(name)
            stack.extend((kid, depth, overlap) for kid in node.kids.values())
        return out


def linked(sets: list, percent: int, probe: list[bool] | None = None) -> list[tuple[int, int]]:
    """Edges (positions) that connect the sets as their links do; only sets marked in ``probe`` look for partners."""
    import numpy as np

    if len(sets) < 2:
        return []
    flat = np.concatenate(sets)
    values, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(values), dtype=np.int64)
    place[np.lexsort((values, -counts))] = np.arange(len(values))
    ends = np.cumsum([0, *map(len, sets)])
    ordered = [np.sort(place[where[a:b]]) for a, b in zip(ends, ends[1:])]
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    edges, tree, has = [], PrefixTree(), np.zeros(len(values), dtype=bool)
    # sets that don't look for partners are stored first; the others look before they are stored
    order = sorted(range(len(sets)), key=lambda i: (bool(probe and probe[i]) if probe else True, i))
    for i in order:
        if probe is None or probe[i]:
            has[ordered[i]] = True
            for j in tree.meets(ordered[i], has, percent, lambda j, i=i: find(j) != find(i)):
                if (a := find(i)) != (b := find(j)):
                    root[a] = b
                    edges.append((i, j))
            has[ordered[i]] = False
        tree.add(ordered[i], i)
    return edges


def _join_units(members: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) found among the sets of each cluster (c) in each unit (k, u, v); members have d, text and probe too."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("c")
        cs = table.column("c").to_numpy()
        ends = [*np.flatnonzero(np.append(True, cs[1:] != cs[:-1])).tolist(), len(cs)]
        a, b = [], []
        for start, end in zip(ends, ends[1:]):
            part = table.slice(start, end - start)
            ds = part.column("d").to_pylist()
            found = linked([shingle_set(t.as_py(), n) for t in part.column("text")], percent, part.column("probe").to_pylist())
            a += [ds[i] for i, _ in found]
            b += [ds[j] for _, j in found]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy("k", "u", "v").applyInArrow(run, "a long, b long")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """c, d, probe of ``texts`` with x, the shingles."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch, 3):
                x = pa.array([shingle_set(t.as_py(), n).view(np.int64) for t in part.column(3)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), x], names=["c", "d", "probe", "x"])

    return texts.select("c", "d", "probe", "text").mapInArrow(run, "c long, d long, probe boolean, x array<long>")


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (c, d, probe, s) of the rarest shingles s in c of each set: so many that two linked sets of c have one of them in
    common."""
    t = sets.select("c", "d", "probe", F.explode("x").alias("s"))
    f = t.groupBy("c", "s").agg(F.count(F.lit(1)).alias("f"))
    own = t.join(f, ["c", "s"]).groupBy("c", "d", "probe").agg(F.sort_array(F.collect_list(F.struct("f", "s")))["s"].alias("a"))
    return own.select("c", "d", "probe", F.explode(F.slice("a", F.lit(1), F.expr(f"size(a) - ({percent} * size(a) + 99) div 100 + 1").cast("int"))).alias("s"))


def _join_sets(rows: DataFrame, percent: int, units: int) -> DataFrame:
    """Edges (a, b) among the sets (d, x) of each c and s of which one is a probe. n_all and n_probes say how many there are; more
    than ``BLOCK`` are dealt to blocks."""
    stored_in, probes_in = F.ceil(F.col("n_all") / BLOCK), F.ceil(F.col("n_probes") / BLOCK)
    r = rows.withColumns({"u": F.pmod(F.xxhash64("d"), stored_in), "v": F.when(F.col("probe"), F.pmod(F.xxhash64("d", F.lit(1)), probes_in))})
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # a set that looks for partners in its own block is stored there by that
    stored = r.select("c", "s", "d", "x", "u", F.explode(F.filter(every(probes_in), lambda v: ~v.eqNullSafe(F.col("v")))).alias("v"), F.lit(False).alias("probe"))
    probes = r.where("probe").select("c", "s", "d", "x", F.explode(every(stored_in)).alias("u"), "v", F.lit(True).alias("probe"))
    both = stored.unionByName(probes).withColumn("run", F.xxhash64("c", "s", "u", "v"))

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("run")
        at = table.column("run").to_numpy()
        ends = [*np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist(), len(at)]
        ds, probe, x = table.column("d").to_pylist(), table.column("probe").to_pylist(), table.column("x")
        a, b = [], []
        for start, end in zip(ends, ends[1:]):
            if end - start > 1:
                sets = [v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in x.slice(start, end - start)]
                for i, j in linked(sets, percent, probe[start:end]):
                    a.append(ds[start + i])
                    b.append(ds[start + j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.select("run", "d", "x", "probe", F.pmod("run", F.lit(units)).alias("k")).groupBy("k").applyInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` (d, h and further columns; h unique) with text: that whose digest is h."""
    shared = docs.sparkSession.sparkContext.broadcast(Filter(classes, "h"))  # 8 MB at most

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            hs = batch.column(0).to_numpy()
            keep = shared.value.may_have(hs)
            for i in np.flatnonzero(keep).tolist():
                if (h := int(hs[i])) in seen:
                    keep[i] = False  # a copy
                    continue
                if len(seen) >= _KEPT:
                    seen.clear()
                seen.add(h)
            yield batch.filter(pa.array(keep, pa.bool_()))

    found = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "h long, text string")
    return found.join(classes, "h").dropDuplicates(["d"])


def links(docs: DataFrame, classes: DataFrame, n_shingles: int, n: int, percent: int) -> DataFrame:
    """Edges (a, b) between set digests, which connect classes as their links do. ``classes`` has node, the digest, and h, the
    digest of one of its texts; ``n_shingles`` is the number of shingles of all documents, by which buckets are counted."""
    share = 3.5 * (100 - percent) / (100 + percent)
    buckets = max(1, math.ceil(n_shingles * share / BUCKET))
    named = written(agreeing(docs, n, percent, buckets), "join-named")
    edges = written(candidates(named), "join-edges")
    ends = edges.select(F.col("a").alias("node"), "n").unionByName(edges.select(F.col("b").alias("node"), "n"))
    hubs = ends.groupBy("node").agg(F.sum("n").alias("hub"))
    clusters = components(edges, "join-clusters", counted="node % 2 = 0").where("node % 2 = 0").join(hubs, "node").join(classes, "node")
    clusters = clusters.select(F.col("node").alias("d"), F.col("root").alias("c"), F.col("size").alias("m"), "hub", "h")
    members = written(texts_of(docs, written(clusters, "join-members")).select("c", "d", "m", "hub", "text"), "join-texts")
    # clusters of one block are dealt to units whole; in larger ones every set goes to the block of its digest
    small = members.where(F.col("m") <= BLOCK)
    units = max(1, -(-small.count() // BLOCK))
    first = small.select("c", F.pmod(F.xxhash64("c"), F.lit(units)).alias("k"), F.lit(-1).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), "d", "text", F.lit(True).alias("probe"))
    blocks = F.ceil(F.col("m") / BLOCK)
    large = members.where(F.col("m") > BLOCK).withColumn("k", F.col("c"))
    some = bool(large.take(1))
    if some:
        own = large.withColumn("u", F.pmod(F.xxhash64("d"), blocks))
        ranked = large.select("c", "d", "hub").withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(64)))
        # the HUBS largest of each cluster, by salt first, so that no sort holds a cluster
        by = [F.desc("hub"), F.asc("d")]
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("c", "salt").orderBy(*by))).where(F.col("r") <= HUBS)
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(*by))).where(F.col("r") <= HUBS)
        hub_sets = large.join(F.broadcast(ranked.select("d")) if ranked.count() <= 100_000 else ranked.select("d"), "d", "left_semi")
        hub_sets = hub_sets.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        both = own.unionByName(hub_sets.where(F.col("u") != F.pmod(F.xxhash64("d"), blocks)))
        first = first.unionByName(both.select("c", "k", "u", F.lit(0).cast("long").alias("v"), "d", "text", F.lit(True).alias("probe")))
    found = written(_join_units(first, n, percent), "join-first")
    if not some:
        return found
    # sets of large clusters that aren't in the largest component meet all blocks
    parts = components(found, "join-parts")
    state = large.select("c", "d", "m").join(parts.select(F.col("node").alias("d"), "root"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    state = written(state, "join-state")
    sizes = state.groupBy("c", "root").agg(F.count(F.lit(1)).alias("s"))
    main = sizes.groupBy("c").agg(F.max(F.struct("s", "root"))["root"].alias("main"))
    outside = salted_join(state, main, "c", "d").where("root <> main").select("c", "d", "m")
    n_out = outside.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_out"), (F.count(F.lit(1)) * F.max("m")).alias("pairs"))
    outside = written(salted_join(outside, n_out, "c", "d").withColumn("v", F.pmod(F.xxhash64("d", F.lit(1)), F.col("n_out"))), "join-outside")
    if not outside.take(1):
        return found
    # their clusters' sets with a rare shingle in common, where that is less than all of them
    state = outside.groupBy("c").agg(F.max("pairs").alias("pairs"))
    sets = large.join(outside.select("d", F.lit(True).alias("probe")), "d", "left").withColumn("probe", F.coalesce("probe", F.lit(False))).select("c", "d", "probe", "text")
    sets = written(_sets(salted_join(sets, state, "c", "d"), n), "join-shingles")
    rare = written(rare_shingles(sets, percent), "join-rare")
    met = written(rare.groupBy("c", "s").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("probe").alias("n_probes")).where("n_all > 1 AND n_probes > 0"), "join-shared")
    work = met.groupBy("c").agg(F.sum(F.col("n_all") * F.col("n_probes")).alias("work"))
    few = written(state.join(work, "c", "left").where("4 * coalesce(work, 0) <= pairs").select("c"), "join-few")
    rows = salted_join(rare, few, "c", "d").join(met, ["c", "s"])
    rows = written(rows.join(sets.select("d", "x"), "d").select("c", "s", "d", "probe", "x", "n_all", "n_probes"), "join-meeting")
    found = found.unionByName(written(_join_sets(rows, percent, max(1, -(-rows.count() // 10_000))), "join-rarely"))
    outside = outside.join(few, "c", "left_anti")
    n_out = n_out.select("c", "n_out").join(few, "c", "left_anti")
    sets = large.withColumn("u", F.pmod(F.xxhash64("d"), blocks)).select("c", "d", "u", "text")
    # a set that looks for partners in its own block is stored there by that
    sets = salted_join(sets, n_out, "c", "d").join(outside.select("d", F.col("v").alias("own")), "d", "left")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n_out") - 1), lambda v: ~v.eqNullSafe(F.col("own")))
    stored = sets.withColumn("v", F.explode(others)).select("c", "u", "v", "d", "text", F.lit(False).alias("probe"))
    # joined before rows are multiplied by the blocks: Spark takes the multiplied rows for as few as before, and would broadcast them
    probes = outside.select("c", "d", "v", "m").join(large.select("d", "text"), "d").withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    probes = probes.select("c", "u", "v", "d", "text", F.lit(True).alias("probe"))
    return found.unionByName(_join_units(stored.unionByName(probes).withColumn("k", F.col("c")), n, percent))


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (least id reachable by links, itself included)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = written(described(docs, n), "join-sets")
    total = table.agg(F.sum("n_shingles")).first()[0] or 0
    classes = table.where("d IS NOT NULL").groupBy(F.col("d").alias("node")).agg(F.min("doc_id").alias("value"), F.count(F.lit(1)).alias("copies"), F.min("h").alias("h"))
    classes = written(classes, "join-classes")
    parts = components(written(links(docs, classes.select("node", "h"), total, n, percent), "join-links"), "join-links", classes.select("node", "value"))
    # only copies, and classes with links, may have another id as component
    moved = classes.join(parts.select("node", "root", F.col("value").alias("least")), "node", "left").where("copies > 1 OR root IS NOT NULL")
    moved = written(moved.select(F.col("node").alias("d"), F.when(F.col("root").isNull(), F.col("value")).otherwise(F.col("least")).alias("component_id")), "join-moved")
    return table.drop("h").join(moved, "d", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
