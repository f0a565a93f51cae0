"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

A document's set holds the hashes (64 bits) of its 5-word shingles; two documents link at a similarity of 0.8 or more.

1. Sets are ordered by one global order: shingles that many documents share come last (the heaviest of all by their
   number of documents), the others by hash. Any fixed order is exact; this one keeps common passages out of the way.
   The list of heavy shingles comes from counts over all documents and has at most HEAVY_ROWS rows; the inverted list of
   a heavy shingle is dealt to several tasks by its length, and what meets it is repeated for each of them.
2. Two linked sets of sizes a and b share a shingle among their first size - ceil(0.8 size) + 1 ones, and k shingles among
   k - 1 more. Light sets (size <= x) enumerate the 2-subsets of the latter prefix and meet on equal subsets. Sets above x,
   and light ones that could link to them, enter inverted lists of the former prefix, which are scanned. The boundary x
   minimises the estimated cost: subsets written, against postings written and pairs met in the lists.
   At the first shingle that two sets share, what stands before it is unshared: the places bound the overlap.
3. Lists of up to SHORT sets give all their pairs.
4. Long lists are not expanded: blocks of members (hubs) are matched against the whole list, linked members
   fall into one component, and only what lies outside a list's largest component is matched again, against
   everything, until nothing is left. No pair across components goes untested, so no link is lost.
5. Candidates whose sketches (256 counts by hash) leave room for a link are tested on their whole sets, links go to connected components.

Exact copies have equal sets, hence one name; only distinct sets take part in 2 to 5. Sets are told apart by 128 bits and
their size; a name is the first 64 of them, or the others for the few sets whose first 64 another set has as well. Null or empty text, and text
without words, has an empty set and is its own class. Documents of fewer than five words have one shingle. Rows that
repeat link to themselves; a null id is the id of its row and never a class's name unless all its class has none. Extra
columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from .common import Scratch, bloom, components, dealt_join, in_bloom, merged, mix64, slices, tidy

#: Bytes of text that are hashed at once, documents counted together for heavy shingles, rows of the heavy list (2 MB).
CHUNK, COUNTED_TOKENS, HEAVY_ROWS = 1 << 18, 700_000, 1 << 18
#: A shingle counts as heavy from so many documents on (a matter of speed only).
HEAVY_FROM = 4
#: The longest list that gives all its pairs, the hubs of the first round, the largest size that may be light.
SHORT, HUBS, LIGHT_MOST = 12, 2, 64
#: Members of a heavy shingle's list that go to one task.
LIST_SHARE = 512
#: One in so many shingles that stand in one document of a chunk is counted, which finds those that are spread thinly.
LONE = 64
#: Pairs that a list may give at once when the members outside its largest component meet all others.
FEW = 100_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: The values of bytes at the first places of a word; further ones are computed.
_PLACES = 64
_BYTES = mix64(mix64(np.arange(_PLACES << 8, dtype=np.uint64) + np.uint64(_OTHER)))


def least_overlap(a, b):
    """Shared shingles that sizes a and b need: 100 i >= 80 (a + b - i)."""
    return -((-4 * (a + b)) // 9)


class Shingler:
    """Word shingles of many texts at once; the work is done by numpy on the texts' bytes."""

    def __init__(self, width: int = 5):
        self.width = width

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        out, part, size = [], [], 0
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass")
            if part and size + len(b) > CHUNK:
                out += self._hashed(part)
                part, size = [], 0
            part.append(b)
            size += len(b) + 1
        return out + (self._hashed(part) if part else [])

    def _hashed(self, part: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer((b"\n".join(part) + b"\n").translate(_LOWER), dtype=np.uint8)
        ends = np.cumsum([len(b) + 1 for b in part])
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
        start, stop = edge[::2], edge[1::2]
        if not len(start):
            return [np.empty(0, np.uint64)] * len(part)
        # a word's hash is the sum of a random value for each byte at its place, scrambled with the length
        size = stop - start
        at = np.cumsum(size) - size
        cell = ((np.arange(at[-1] + size[-1]) - np.repeat(at, size)) << 8) | data[~blank]
        value = _BYTES[np.minimum(cell, (_PLACES << 8) - 1)]
        far = np.flatnonzero(cell >= _PLACES << 8)
        with np.errstate(over="ignore"):
            value[far] = mix64(mix64(cell[far].astype(np.uint64) + np.uint64(_OTHER)))
            words = mix64(np.add.reduceat(value, at) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            seeds = mix64(np.arange(1, self.width + 2, dtype=np.uint64) * np.uint64(_ODD)) | np.uint64(1)
            of = np.searchsorted(ends, start, side="right")
            first = np.searchsorted(of, np.arange(len(part)))
            n = np.diff(np.append(first, len(words)))
            grams = np.zeros(max(0, len(words) - self.width + 1), dtype=np.uint64)
            for j in range(self.width):
                grams += words[j : j + len(grams)] * seeds[j]
            grams = mix64(grams + seeds[self.width])
        out = []
        for f, k in zip(first.tolist(), n.tolist()):
            if k >= self.width:
                s = np.sort(grams[f : f + k - self.width + 1])
                if len(s) > 1:
                    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif k:
                with np.errstate(over="ignore"):
                    s = mix64((words[f : f + k] * seeds[:k]).sum(keepdims=True) + np.uint64(k))
            else:
                s = np.empty(0, np.uint64)
            out.append(s)
        return out


def fingerprint(s: np.ndarray, odd: int = _ODD) -> int:
    """64 bits of a sorted set, as a signed integer; another odd number gives 64 others."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s * np.uint64(odd) + np.uint64(7)).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def named(s: np.ndarray, shared: frozenset[int]) -> int:
    """A set's name: its first 64 bits, or the others if another set shares the first."""
    f = fingerprint(s)
    return fingerprint(s, _OTHER) if f in shared else f


def prefix(n: int, k: int = 1) -> int:
    """Members of a set of size n among which it shares k with any set that it links to."""
    return n - -((-4 * n) // 5) + k


def _counted(docs: DataFrame, width: int) -> DataFrame:
    """Rows (kind, key, n, lone): shingles (0) with their documents in chunks that hold two or more of them, and how many
    chunks of one were drawn, one in LONE; set sizes (1) with documents, (2) with pairs met in the lists."""

    most = COUNTED_TOKENS

    def count(batches):
        shingler = Shingler(width)
        kept: list[np.ndarray] = []
        held, seen, chunk = 0, set(), TaskContext.get().partitionId() << 20

        def emit():
            """Counts of the sets held, copies left out."""
            every = np.concatenate(kept)
            found, back, times = np.unique(every, return_inverse=True, return_counts=True)
            sizes = np.array([len(s) for s in kept])
            firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            met = np.concatenate([[0], np.cumsum(np.minimum(times, SHORT)[back] - 1)])
            pairs = met[firsts + np.array([prefix(n) for n in sizes])] - met[firsts]
            cell = np.minimum(sizes, LIGHT_MOST + 1)
            docs_at, pairs_at = (np.bincount(cell, w, LIGHT_MOST + 2) for w in (None, pairs))
            u = np.arange(LIGHT_MOST + 2)
            drawn = mix64(found ^ mix64(np.array([chunk], dtype=np.uint64))) % np.uint64(LONE) == 0
            some = (times > 1) | drawn
            key = np.concatenate([found[some].view(np.int64), u, u])
            kind = np.repeat([0, 1, 2], [some.sum(), len(u), len(u)]).astype(np.int32)
            alone = np.concatenate([times[some] == 1, np.zeros(2 * len(u), bool)]).astype(np.int64)
            n = np.concatenate([times[some], docs_at.astype(np.int64), pairs_at.astype(np.int64)]) * (1 - alone)
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(n.astype(np.int64)), pa.array(alone)], ["kind", "key", "n", "lone"])

        for batch in slices(batches):
            for s in shingler(batch.column(0).to_pylist()):
                if len(s) and (f := fingerprint(s)) not in seen:
                    seen.add(f)
                    kept.append(s)
                    held += len(s)
                    if held >= most:
                        yield emit()
                        kept, held, chunk = [], 0, chunk + 1
                        seen.clear()
        if kept:
            yield emit()

    return docs.select("text").mapInArrow(tidy(count), "kind int, key long, n long, lone long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("lone").alias("lone"))


def boundary(docs_at: dict[int, int], pairs_at: dict[int, int], subset_cost: float = 1.0, posting_cost: float = 1.0, pair_cost: float = 1.0) -> int:
    """The largest light size x of least cost; size LIGHT_MOST + 1 stands for all larger ones, which are never light."""
    best = (math.inf, 0)
    for x in range(LIGHT_MOST + 1):
        light = sum(n * subset_cost * math.comb(prefix(s, 2), 2) for s, n in docs_at.items() if s <= x)
        heavy = sum(n * posting_cost * prefix(s) + pair_cost * pairs_at.get(s, 0) for s, n in docs_at.items() if 5 * s >= 4 * (x + 1) and s <= LIGHT_MOST)
        best = min(best, (light + heavy, x))
    return best[1]


class Order:
    """The global order: shingles of the heavy list last, by rank; the others by hash.

    n: documents of each heavy one, whose list goes to a task for each `most` of them.
    """

    def __init__(self, heavy: np.ndarray, n: np.ndarray, most: int):
        by = np.argsort(heavy, kind="stable")
        self.keys, self.rank, self.dealt = heavy[by], by, -(-n[by] // most)
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(heavy >> np.uint64(42)).astype(np.int64)] = True

    def shares(self, s: np.ndarray) -> np.ndarray:
        """The tasks to which the lists of some shingles are dealt; 1 for those that are not heavy."""
        if not len(self.keys):
            return np.ones(len(s), dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        return np.where(self.keys[at] == s, self.dealt[at], 1).astype(np.int32)

    def __call__(self, s: np.ndarray, n: int) -> np.ndarray:
        """The first n of a sorted set."""
        spot = np.flatnonzero(self.seen[(s >> np.uint64(42)).astype(np.int64)])
        if not len(spot):
            return s[:n]
        at = np.minimum(np.searchsorted(self.keys, s[spot]), len(self.keys) - 1)
        is_heavy = self.keys[at] == s[spot]
        cold = np.delete(s, spot[is_heavy])
        if len(cold) >= n:
            return cold[:n]
        hot = s[spot[is_heavy]][np.argsort(self.rank[at[is_heavy]], kind="stable")]
        return np.concatenate([cold, hot])[:n]


def _postings(docs: DataFrame, width: int, heavy: tuple[np.ndarray, np.ndarray, int], x: int, shared: frozenset[int]) -> DataFrame:
    """Rows (key, light, fp, n, room, shares): subsets of light sets, and the inverted lists' entries. Copies go once, as far as a task remembers.

    room: the most that the set can share with one it meets here first, for what stands before in the order is then unshared.
    shares: tasks to which the key's list is dealt by set, more than one if all shingles of the key are heavy.
    """

    def post(batches):
        shingler, order = Shingler(width), Order(*heavy)
        seen: set[int] = set()
        for batch in slices(batches):
            if len(seen) > 200_000:
                seen.clear()
            keys, light, fps, sizes, rooms, shares = [], [], [], [], [], []
            for s in shingler(batch.column(0).to_pylist()):
                n = len(s)
                if not n or (f := named(s, shared)) in seen:
                    continue
                seen.add(f)
                if n <= x:
                    p = order(s, prefix(n, 2))
                    i, j = np.triu_indices(len(p), 1) if n > 1 else (np.zeros(1, int),) * 2
                    rooms.append(n - j + (n > 1))
                    known = order.shares(p)
                    shares.append(np.minimum(known[i], known[j]))
                    with np.errstate(over="ignore"):
                        keys.append(mix64(np.minimum(p[i], p[j]) * np.uint64(_ODD) + mix64(np.maximum(p[i], p[j]))) if n > 1 else p)
                    light.append(np.ones(len(keys[-1]), bool))
                    fps.append(np.full(len(keys[-1]), f))
                    sizes.append(np.full(len(keys[-1]), n, np.int32))
                if 5 * n >= 4 * (x + 1):
                    keys.append(order(s, prefix(n)))
                    rooms.append(n - np.arange(len(keys[-1])))
                    shares.append(order.shares(keys[-1]))
                    light.append(np.zeros(len(keys[-1]), bool))
                    fps.append(np.full(len(keys[-1]), f))
                    sizes.append(np.full(len(keys[-1]), n, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(light)), pa.array(np.concatenate(fps)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(rooms).astype(np.int32)), pa.array(np.concatenate(shares))], ["key", "light", "fp", "n", "room", "shares"])

    return docs.select("text").mapInArrow(tidy(post), "key long, light boolean, fp long, n int, room int, shares int")


def _sets(docs: DataFrame, width: int, wanted: np.ndarray, shared: frozenset[int]) -> DataFrame:
    """(fp, s) of the distinct sets of documents whose id the Bloom filter `wanted` may hold, or is null."""

    def some(batches):
        shingler = Shingler(width)
        for batch in slices(batches):
            ids = batch.column(0)
            hits = in_bloom(wanted, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            found = {named(s, shared): s for s in shingler(batch.column(1).filter(pa.array(hits)).to_pylist()) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.int64()), pa.array([s.view(np.int64) for s in found.values()], type=pa.list_(pa.int64()))], ["fp", "s"])

    return docs.select("doc_id", "text").mapInArrow(tidy(some), "fp long, s array<long>").dropDuplicates(["fp"])


#: Cells of a sketch: how many of a set's members have each value of the top bits of the hash.
CELLS = 256


def sketch(s: np.ndarray) -> np.ndarray | None:
    """Members of a set by cell; None where a cell overflows a byte."""
    n = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS)
    return n.astype(np.int8) if n.max(initial=0) < 128 else None


def signatures(docs: DataFrame, width: int = 5, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, fp, other, sketch) of every row; fp and other, 64 bits each, are null for an empty set."""

    def sign(batches):
        shingler = Shingler(width)
        for batch in slices(batches):
            sets = shingler(batch.column(1).to_pylist())
            cells = pa.array([sketch(s) if len(s) else None for s in sets], type=pa.list_(pa.int8()))
            names = [pa.array([fingerprint(s, odd) if len(s) else None for s in sets], type=pa.int64()) for odd in (_ODD, _OTHER)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], type=pa.int64()), *names, cells], ["doc_id", "n_shingles", "fp", "other", "sketch"])

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), "text").mapInArrow(tidy(sign), "doc_id long, n_shingles long, fp long, other long, sketch array<tinyint>")


def _possible(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs whose sketches leave room for a link: no cell shares more than its lesser count."""
    side = lambda c: own.select(F.col("fp").alias(c), F.col("sketch").alias(f"s{c}"))
    most = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.coalesce(9 * most >= 4 * (F.col("na") + F.col("nb")), F.lit(True))).select("a", "b", "na", "nb")


def _linked(pairs: DataFrame, docs: DataFrame, own: DataFrame, width: int, shared: frozenset[int]) -> DataFrame:
    """The pairs (a, b, na, nb) whose sets are similar enough; the sets in question are made anew and shuffled once."""
    fps = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    sets = _sets(docs, width, bloom(fps.join(own, "fp").where("least is not null"), "least"), shared)
    one = dealt_join(pairs, sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a", "b")
    both = dealt_join(one, sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b", "a", counts=pairs)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= 80 * (F.col("na") + F.col("nb") - common)).select("a", "b")


_SIZES = "5 * least(na, nb) >= 4 * greatest(na, nb)"
#: What two sets that meet here first may still share is enough for a link.
_ROOM = "9 * least(ra, rb) >= 4 * (na + nb)"
_LIST = ("key", "light", "shares")


def _share() -> Column:
    return F.when(F.col("shares") > 1, F.pmod(F.xxhash64("fp"), F.col("shares"))).otherwise(0).cast("int")


def _for_all(rows: DataFrame) -> DataFrame:
    """Rows of lists, repeated for every share of their list."""
    return rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))


def _met(members: DataFrame, others: DataFrame, condition: str = "true") -> DataFrame:
    """Pairs (a, b, na, nb), a < b, of members with others of the same list and other components; both with their share."""
    left = members.select("key", "light", "share", F.col("fp").alias("f"), F.col("n").alias("na"), F.col("room").alias("ra"), F.col("root").alias("fr"))
    right = others.select("key", "light", "share", F.col("fp").alias("h"), F.col("n").alias("nb"), F.col("room").alias("rb"), F.col("root").alias("hr"))
    met = left.join(right, ["key", "light", "share"]).where(f"fr != hr and {_SIZES} and {_ROOM} and {condition}")
    swap = F.col("f") > F.col("h")
    return met.select(F.least("f", "h").alias("a"), F.greatest("f", "h").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb")).distinct()


def _hubs(members: DataFrame, hubs: int, turn: int) -> DataFrame:
    """Up to `hubs` members of each list: the least of each cell of a hash, so that lists of like members have like hubs."""
    cell = F.pmod(F.xxhash64("fp", F.lit(turn)), F.lit(hubs))
    return members.groupBy(*_LIST, cell.alias("cell")).agg(F.min(F.struct("fp", "n", "room", "root")).alias("h")).select(*_LIST, "h.*")


def linked_sets(docs: DataFrame, own: DataFrame, scratch: Scratch, width: int = 5, shared: frozenset[int] = frozenset()) -> DataFrame:
    """Components (id, root) of linked distinct sets, by name; own: (fp, least doc_id, sketch)."""
    counted = scratch.keep(_counted(docs, width), "counted")
    weight = (F.col("n") + LONE * F.col("lone")).alias("n")
    heavy = counted.where((F.col("kind") == 0) & ((F.col("n") >= HEAVY_FROM) | (F.col("lone") > 1))).select(weight, "key").orderBy(F.desc("n"), "key").limit(HEAVY_ROWS).toArrow()
    heavy = heavy["key"].to_numpy()[::-1].view(np.uint64).copy(), heavy["n"].to_numpy()[::-1].copy(), LIST_SHARE  # the most shared ones last
    cells = counted.where("kind > 0").collect()  # at most 2 (LIGHT_MOST + 2) rows
    scratch.drop("counted")
    x = boundary(*({r["key"]: r["n"] for r in cells if r["kind"] == k and r["key"]} for k in (1, 2)))
    linked = lambda pairs, name: scratch.keep(_linked(pairs, docs, own, width, shared), name)

    by = ["key", "light", "share"]
    posted = _postings(docs, width, heavy, x, shared).withColumn("share", _share())
    listed = posted.repartition(*by).dropDuplicates([*by, "fp"]).withColumn("df", F.count("*").over(Window.partitionBy(*by))).where("shares > 1 or df > 1")
    listed = scratch.keep(listed, "listed")
    is_short = (F.col("shares") == 1) & (F.col("df") <= SHORT)
    short, long = listed.where(is_short).withColumn("root", F.col("fp")), listed.where(~is_short).select(*_LIST, "share", "fp", "n", "room", F.col("fp").alias("root"))
    # two light sets meet on subsets, so their shingles' lists need not bring them together as well
    near = _met(short, short, f"f < h and (light or greatest(na, nb) > {x})")
    hubs = scratch.keep(_hubs(long, HUBS, 0), "hubs-0")
    pairs = scratch.keep(_possible(near.unionByName(_met(long, _for_all(hubs))).distinct(), own), "pairs-0")
    # each set meets its least partner first; then only pairs across components are left, fewer by far
    least = scratch.keep(pairs.groupBy("b").agg(F.min(F.struct("a", "na", "nb")).alias("p")).select("p.a", "b", "p.na", "p.nb"), "least")
    roots = components(scratch, linked(least, "first"), "first-roots")
    side = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    across = pairs.join(least.select("a", "b"), ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(ra, a) != coalesce(rb, b)")
    across = scratch.keep(across.select("a", "b", "na", "nb"), "across")
    roots = merged(scratch, roots, linked(across, "links-0"), "roots-0")
    scratch.drop_all_but("listed", "hubs-0", "roots-0-merged")
    turn, now = 0, "roots-0-merged"
    while not long.isEmpty():
        # hubs have met all of their lists; of the rest, pairs across components are left
        rest = long.join(hubs.select(*_LIST, "fp"), [*_LIST, "fp"], "left_anti")
        labelled = scratch.keep(rest.drop("root").join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), f"labelled-{turn}")
        by_root = labelled.groupBy(*_LIST, "root").agg(F.count("*").alias("c"))
        most = by_root.groupBy(*_LIST).agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("all")).select(*_LIST, F.col("m.root").alias("main"), F.col("m.c").alias("largest"), "all")
        lists = scratch.keep(labelled.join(_for_all(most.where("largest < all")), [*_LIST, "share"]), f"lists-{turn}")
        scratch.drop_all_but(f"lists-{turn}", now)
        # few pairs are left, or links are rare: members outside the largest component meet all others; else more hubs do
        turn += 1
        left = (F.col("all") - F.col("largest")) * F.col("all")
        is_few = (left <= FEW) | ((8 * F.col("largest") <= F.col("all")) & (left <= 40 * FEW)) | (F.col("all") <= HUBS * 4**turn)
        few = lists.where(is_few)
        long = scratch.keep(lists.where(~is_few).drop("main", "largest", "all"), f"open-{turn}")
        hubs = scratch.keep(_hubs(long, HUBS * 4**turn, turn), f"hubs-{turn}")
        met = _met(few, _for_all(few.where("root != main").drop("share"))).unionByName(_met(long, _for_all(hubs)))
        pairs = scratch.keep(_possible(met.distinct(), own), f"pairs-{turn}")
        if not pairs.isEmpty():
            roots = merged(scratch, roots, linked(pairs, f"links-{turn}"), f"roots-{turn}")
            now = f"roots-{turn}-merged"
        scratch.drop_all_but(f"open-{turn}", f"hubs-{turn}", now)
    return roots


def _classified(docs: DataFrame, width: int, id_column: str) -> tuple[DataFrame, Scratch, frozenset[int]]:
    """A table (doc_id, n_shingles, fp, root, component_id) of every row; the last but doc_id and n_shingles are null for empty sets."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), "text")
    signed = scratch.keep(signatures(texts, width), "signed")
    sets = signed.where("fp is not null").groupBy("fp", "other", "n_shingles").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"))
    own = scratch.keep(sets, "own")
    # sets that share their first 64 bits: n * n / 2 ** 65 of n are to be expected, none below ten billion texts
    shared = frozenset(r["fp"] for r in own.groupBy("fp").count().where("count > 1").select("fp").collect())
    if shared:
        name = F.when(F.col("fp").isin(*shared), F.col("other")).otherwise(F.col("fp"))
        own, signed = own.withColumn("fp", name), signed.withColumn("fp", name)
    one = Scratch(docs.sparkSession, "jaccard-sets")
    roots = linked_sets(texts, own.select("fp", "least", "sketch"), one, width, shared)
    rooted = scratch.keep(own.select("fp", "least").join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = scratch.keep(dealt_join(rooted, names, "root", "fp").select("fp", "root", "component_id"), "classed")
    found = dealt_join(signed.select("doc_id", "n_shingles", "fp"), classed, "fp", "doc_id", "left")
    found = scratch.keep(found, "found")
    scratch.drop_all_but("found")
    one.drop_all_but()
    return found, scratch, shared


def classes(docs: DataFrame, width: int = 5, id_column: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id of its class), fp."""
    found, _, _ = _classified(docs, width, id_column)
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "fp")


def _named_rows(docs: DataFrame, width: int, doubted: np.ndarray, shared: frozenset[int], sure: bool, name: str) -> DataFrame:
    """The rows of docs that surely stay (sure), or those in doubt with their set's name: an id that the filter may hold, or none."""
    schema = docs.schema if sure else T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    columns = docs.columns

    def rows(batches):
        shingler = Shingler(width)
        for batch in slices(batches):
            ids = batch.column(columns.index("doc_id")).cast(pa.int64())
            maybe = in_bloom(doubted, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(maybe)
            sets = shingler(batch.column(columns.index("text")).take(pa.array(at)).to_pylist())
            filled = np.array([len(s) > 0 for s in sets], dtype=bool)
            if sure:
                maybe[at] = filled
                yield batch.filter(pa.array(~maybe))
            else:
                some = batch.take(pa.array(at[filled]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([named(s, shared) for s in sets if len(s)], type=pa.int64())], [*columns, name])

    return docs.mapInArrow(tidy(rows), schema)


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with one row of each class: the one of the smallest doc_id (of equal ids, one set of them, and one row of it).

    Rows are known by doc_id and set, so ids that repeat or are null lose no row of another class; rows without words are
    classes of their own and stay. Only rows whose id a Bloom filter of the ids in question may hold are shuffled.
    """
    found, scratch, shared = _classified(docs, width, "doc_id")
    rows = scratch.keep(found.where("fp is not null").groupBy("doc_id", "fp", "root").agg(F.count("*").alias("c")), "rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("w")).select("root", F.col("w.doc_id").alias("w_id"), F.col("w.fp").alias("w_fp"))
    told = dealt_join(rows, first, "root", "fp").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("fp") == F.col("w_fp")))
    told = scratch.keep(told.where("not stays or c > 1").select("doc_id", "fp", "stays"), "told")
    doubted = bloom(told.where("doc_id is not null"), "doc_id")
    name = next(n for n in (f"set_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    sure = _named_rows(docs, width, doubted, shared, True, name)
    unsure = _named_rows(docs, width, doubted, shared, False, name).dropDuplicates(["doc_id", name])
    gone = told.where("not stays").select(F.col("doc_id").alias("g_id"), F.col("fp").alias("g_fp"))
    kept = unsure.join(gone, unsure["doc_id"].cast("long").eqNullSafe(gone["g_id"]) & (unsure[name] == gone["g_fp"]), "left_anti")
    return sure.unionByName(kept.drop(name))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
  ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i : i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = w.doc_id"""
